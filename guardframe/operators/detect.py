"""Input detection: categories, labels and signals as Columns.

Everything is a chain of JVM regex tests on one text column: no shuffle, no
Python, and the scan reads only that column. A literal that every match must
hold is tested first, so most rows skip the costly patterns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.functions import patterns as P
from guardframe.functions.strings import matches


@dataclass(frozen=True)
class Entities:
    """Which kinds of personal data are looked for."""

    email: bool = True
    phone: bool = True
    credit_card: bool = True
    iban: bool = True
    tokens: bool = True


#: Labels in their order: name, pattern, toggle, and what every match holds.
LABELS = (
    ("pii.email", P.EMAIL, "email", "@"),
    ("pii.phone", P.PHONE, "phone", None),
    ("pii.credit_card", P.CREDIT_CARD, "credit_card", None),
    ("pii.iban", P.IBAN, "iban", None),
    ("pii.token", P.TOKEN, "tokens", None),
)


def banned_terms(words: Iterable[str]) -> list[str]:
    """Trimmed, without blanks and case-insensitive repeats; the first spelling stays."""
    out: dict[str, str] = {}
    for word in words:
        trimmed = word.strip()
        if trimmed:
            out.setdefault(trimmed.lower(), trimmed)
    return list(out.values())


def _lower(text: Column) -> Column:
    return F.lower(F.translate(text, "İ", "i"))


def banned(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for term in banned_terms(words):
        found = found | F.contains(_lower(text), F.lit(term.lower()))
    return found


def label_hits(text: Column, entities: Entities) -> dict[str, Column]:
    """For each label whether it is found; labels that are switched off are left out."""
    found = {}
    for name, pattern, toggle, literal in LABELS:
        if getattr(entities, toggle):
            test = matches(text, pattern)
            found[name] = text.contains(literal) & test if literal else test
    return found


def pii_labels(text: Column, entities: Entities = Entities()) -> Column:
    """The labels found, in their fixed order."""
    return listed(label_hits(text, entities))


def categories(text: Column, entities: Entities = Entities(), words: Iterable[str] = (), labels: dict[str, Column] | None = None) -> dict[str, Column]:
    """For each input category whether it is hit; ``labels``, if given, are the label hits."""
    labels = label_hits(text, entities) if labels is None else labels
    personal = F.lit(False)
    for hit in labels.values():
        personal = personal | hit
    return {
        "banned_words": banned(text, words),
        "pii": personal,
        "secrets": labels.get("pii.token", F.lit(False)),
        "injection": matches(text, P.SQL_INJECTION) | matches(text, P.COMMAND_INJECTION),
        "prompt_injection": matches(text, P.PROMPT_INJECTION),
        "jailbreak": matches(text, P.JAILBREAK),
        "toxicity": matches(text, P.TOXICITY),
    }


def output_hit(text: Column) -> Column:
    return matches(text, P.OUTPUT_REDACTION)


def labelled(df: DataFrame, text: Column, entities: Entities = Entities()) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a boolean column for each label, and these columns by label; their names begin
    with ``__label_``. What is made of them doesn't test the patterns again."""
    own = {name: (f"__label_{name.replace('.', '_')}", hit) for name, hit in label_hits(text, entities).items()}
    return df.withColumns(dict(own.values())), {name: F.col(column) for name, (column, _) in own.items()}


def listed(labels: dict[str, Column]) -> Column:
    """The labels found, in their fixed order."""
    return F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit in labels.items())), lambda x: x.isNotNull()) if labels else F.array().cast("array<string>")


def with_categories(df: DataFrame, text: str = "text", entities: Entities = Entities(), words: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``labels`` and a boolean ``hit_<category>`` for each category.

    Columns of ``df`` with these names are replaced; names that begin with
    ``__label_`` are reserved.
    """
    out, labels = labelled(df, F.col(text), entities)
    found = categories(F.col(text), entities, words, labels)
    out = out.withColumns({"labels": listed(labels)} | {f"hit_{name}": hit for name, hit in found.items()})
    return out.drop(*(c for c in out.columns if c.startswith("__label_")))


def with_signals(df: DataFrame, text: str = "text", entities: Entities = Entities()) -> DataFrame:
    """``df`` with ``signals``, those of the regex detectors on the text."""
    out, labels = labelled(df, F.col(text), entities)
    return out.withColumn("signals", regex_signals(listed(labels), categories(F.col(text), entities, (), labels))).drop(*(c for c in out.columns if c.startswith("__label_")))


def signal(category: Column | str, source: Column | str, confidence: Column, evidence: Column | str | None = None) -> Column:
    """A detection signal: category, source, confidence (single precision) and evidence."""
    as_column = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.struct(
        as_column(category).alias("category"), as_column(source).alias("source"), confidence.cast("float").alias("confidence"), as_column(evidence).cast("string").alias("evidence")
    )


def regex_signals(labels: Column, hits: dict[str, Column]) -> Column:
    """Signals of the regex detectors, in a fixed order.

    A token label counts as a secret; the secrets category adds a second signal;
    toxicity and banned words give none.
    """
    one = F.lit(1.0)
    from_labels = F.transform(labels, lambda x: signal(F.when(x.contains("token"), "secrets").otherwise("pii"), "regex", one, x))
    rest = [F.when(hits[name], signal(name, "regex", one)) for name in ("secrets", "injection", "prompt_injection", "jailbreak")]
    return F.filter(F.concat(from_labels, F.array(*rest)), lambda x: x.isNotNull())
