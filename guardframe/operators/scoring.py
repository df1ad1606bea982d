"""Model outputs: probabilities, class choice, entity labels and spans.

Logits come from models that run in Arrow batches (``analyzed``); what follows from
them, scores, flags, entities, is native expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def softmax(logits: Column) -> Column:
    """Shifted softmax: exponentials in double, stored in single precision."""
    shift = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - shift).cast("double")))
    total = F.aggregate(powers, F.lit(0.0), lambda n, x: n + x)
    return F.transform(powers, lambda x: (x.cast("float").cast("double") / total).cast("float"))


def sigmoid(x: Column) -> Column:
    return (1.0 / (1.0 + F.exp(-x.cast("double")))).cast("float")


def argmax(values: Column) -> Column:
    """Index from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def logits_row(logits: Column, classes: int) -> Column:
    """The first row of class logits, if more were returned."""
    return F.when(F.size(logits) > classes, F.slice(logits, 1, classes)).otherwise(logits)


def sequence_score(logits: Column, classes: int, attack: int) -> Column:
    """Probability of the attack class; of a single logit its sigmoid."""
    row = logits_row(logits, classes)
    return sigmoid(F.try_element_at(row, F.lit(1))) if classes <= 1 else F.try_element_at(softmax(row), F.lit(attack + 1))


ATTACK_WORDS = {"prompt_injection": ("injection", "attack", "unsafe"), "jailbreak": ("jailbreak", "attack", "unsafe")}


def attack_class(model: str, labels: dict[int, str]) -> int:
    """Which class means an attack: the first whose label says so; a safe label of two
    gives the other one; else the first that isn't a safe or numbered label; else 1."""
    words = ATTACK_WORDS.get(model, ("attack", "unsafe"))
    safe = lambda label: "safe" in label or "benign" in label
    low = {i: labels[i].lower() for i in sorted(labels)}
    named = next((i for i, label in low.items() if any(w in label for w in words)), None)
    if named is not None:
        other = 0 if named == 1 else 1
        return other if len(labels) == 2 and safe(low[named]) and other in low else named
    if len(labels) == 2:
        plain = next((i for i, label in low.items() if label not in ("label_0", "label_1") and not safe(label)), None)
        if plain is not None:
            return plain
        return next((i for i in (1, 0) if i in low), 1)
    return 1


def flags(scores: Column, thresholds: dict[str, tuple[float, float]]) -> Column:
    """``<label>_high`` at the block threshold, else ``<label>_medium`` at the warn threshold."""
    out = []
    for label, (warn, block) in thresholds.items():
        score = F.element_at(scores, label)
        out.append(F.when(score >= F.lit(block).cast("float"), f"{label}_high").when(score >= F.lit(warn).cast("float"), f"{label}_medium"))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def verdict(flag_list: Column) -> Column:
    return F.coalesce(F.try_element_at(flag_list, F.lit(1)), F.lit("clean"))


def max_score(scores: Column) -> Column:
    return F.greatest(F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0).cast("float")), F.lit(0.0).cast("float"))


_ENTITY = "array<struct<entity_type:string,start_byte:int,end_byte:int>>"


def _span(kind: Column, start: Column, end: Column) -> Column:
    return F.struct(kind.alias("entity_type"), start.cast("int").alias("start_byte"), end.cast("int").alias("end_byte"))


def merged_spans(spans: Column) -> Column:
    """Spans by (start, end); one that touches or overlaps the one before and is of the same type, in any case, extends it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start_byte"], s["end_byte"], s["entity_type"])))

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        joins = (s["start_byte"] <= last["end_byte"]) & (F.lower(s["entity_type"]) == F.lower(last["entity_type"]))
        longer = F.array(_span(last["entity_type"], last["start_byte"], F.greatest(last["end_byte"], s["end_byte"])))
        return F.when((F.size(kept) > 0) & joins, F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), longer)).otherwise(F.concat(kept, F.array(_span(s["entity_type"], s["start_byte"], s["end_byte"]))))

    return F.aggregate(ordered, F.array().cast(_ENTITY), step)


def merged_rows(spans: DataFrame, *keys: str) -> DataFrame:
    """``spans`` (keys, ``start_byte``, ``end_byte``; no end before its start) merged within their
    keys where they touch or overlap, as ``merged_spans`` does in a row.

    Spans of equal start are one before the shuffle, so a hot key costs a row per
    start and task; the running end needs no more than one row at a time.
    """
    ordered = Window.partitionBy(*keys).orderBy("start_byte")
    before = F.max("end_byte").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start_byte") > before), 1).otherwise(0)
    least = spans.groupBy(*keys, "start_byte").agg(F.max("end_byte").alias("end_byte"))
    runs = least.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte")).drop("__run")


def entities(labels: Column, offsets: Column) -> Column:
    """Spans from token labels (B-x, I-x, O) and their byte offsets (start, end).

    A token without an offset is skipped and ends nothing; a label without a
    prefix, or an I of the open type, carries on.
    """
    tokens = F.filter(F.arrays_zip(labels.alias("label"), offsets.alias("offset")), lambda t: (t["offset"]["start"] >= 0) & (t["offset"]["end"] > t["offset"]["start"]))
    begin = F.struct(F.array().cast(_ENTITY).alias("done"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        label = F.trim(F.coalesce(t["label"], F.lit("")))
        dash = F.instr(label, "-")
        prefix = F.when(dash > 0, F.substring_index(label, "-", 1)).otherwise("")
        kind = F.when(dash > 0, F.regexp_replace(label, r"^[^-]*-", "")).otherwise(label)
        last = F.try_element_at(acc["done"], F.lit(-1))
        new = F.concat(acc["done"], F.array(_span(kind, t["offset"]["start"], t["offset"]["end"])))
        grown = F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(_span(last["entity_type"], last["start_byte"], F.greatest(last["end_byte"], t["offset"]["end"].cast("int")))))
        ends = (kind == "") | (F.upper(label) == "O")
        starts = (prefix == "B") | ~acc["open"] | (F.lower(last["entity_type"]) != F.lower(kind))
        result = lambda done, is_open: F.struct(done.alias("done"), is_open.alias("open"))
        return F.when(ends, result(acc["done"], F.lit(False))).when(starts, result(new, F.lit(True))).when(prefix == "I", result(grown, F.lit(True))).otherwise(acc)

    return merged_spans(F.aggregate(tokens, begin, step, lambda acc: acc["done"]))


#: A model: from a batch of token ids and masks to logits, for each text a list (of classes) or a list of lists (of tokens' classes).
Infer = Callable[[list[list[int]], list[list[int]]], list]


@dataclass(frozen=True)
class Specialist:
    """A single-purpose model. ``load`` gives its tokenizer and what runs it, once for each task."""

    load: Callable[[], tuple[object, Infer]]
    labels: dict[int, str]
    length: int = 256


def input_text(system: Column, user: Column) -> Column:
    """What the model that scores all labels reads."""
    return F.concat(F.lit("[SYSTEM]\n"), F.coalesce(system, F.lit("")), F.lit("\n[USER]\n"), F.coalesce(user, F.lit("")))


def analyzed(df: DataFrame, text: str, specialists: dict[str, Specialist], column: str = "analysis") -> DataFrame:
    """``df`` with a struct of ``logits`` (by sequence model), ``labels`` and ``offsets`` (of the
    token model ``pii_ner``) and ``errors``: what the models say of each text.

    A model that fails leaves an error and nothing else of its own; what the
    others found is kept. A blank text isn't given to sequence models. Models are
    loaded once for each task and run over Arrow batches.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = T.StructType(
        [
            T.StructField("logits", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
            T.StructField("labels", T.ArrayType(T.StringType())),
            T.StructField("offsets", T.ArrayType(span)),
            T.StructField("errors", T.ArrayType(T.StringType())),
        ]
    )
    schema = T.StructType([*df.schema.fields, T.StructField(column, kind)])

    def run(batches):
        import pyarrow as pa

        arrow = pa.struct([("logits", pa.map_(pa.string(), pa.list_(pa.float32()))), ("labels", pa.list_(pa.string())), ("offsets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("errors", pa.list_(pa.string()))])
        loaded = {name: s.load() for name, s in specialists.items()}
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [{"logits": [], "labels": None, "offsets": None, "errors": []} for _ in texts]
            for name, (tokenizer, infer) in loaded.items():
                own = specialists[name]
                asked = [i for i, t in enumerate(texts) if t.strip()] if name != "pii_ner" else list(range(len(texts)))
                try:
                    if name == "pii_ner":
                        rows = [tokenizer.encode_with_offsets(texts[i], own.length) for i in asked]
                    else:
                        rows = [tokenizer.encode(texts[i], own.length) for i in asked]
                    said = infer([r[0] for r in rows], [r[1] for r in rows]) if rows else []
                    for i, row, logits in zip(asked, rows, said, strict=True):
                        if name == "pii_ner":
                            best = [max(range(len(c)), key=lambda k: (c[k], -k)) for c in logits]  # noqa: B023
                            found[i]["labels"] = [own.labels.get(k, "O") for k in best]
                            found[i]["offsets"] = [{"start": s, "end": e} for s, e in row[2]]
                        else:
                            found[i]["logits"].append((name, [float(x) for x in logits]))
                except Exception as error:  # noqa: BLE001  any fault of a model is its own
                    for one in found:
                        one["errors"].append(f"{name}: {error}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, column])

    return df.mapInArrow(run, schema)


def specialist_results(df: DataFrame, specialists: dict[str, Specialist], column: str = "analysis") -> DataFrame:
    """``df`` with ``scores`` (by model; 0 for a blank text, and contains_personal_data 1 or 0)
    and ``entities``, from what ``analyzed`` added. A failed model has no score."""
    entries = []
    failed = lambda name: F.exists(F.col(f"{column}.errors"), lambda e: e.startswith(f"{name}: "))
    pair = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("float").alias("value"))
    for name, own in specialists.items():
        if name == "pii_ner":
            continue
        logits = F.element_at(f"{column}.logits", name)
        score = sequence_score(logits, len(own.labels), attack_class(name, own.labels))
        entries.append(F.when(~failed(name), pair(name, F.coalesce(score, F.lit(0.0)))))
    if "pii_ner" in specialists:
        df = df.withColumn("entities", F.coalesce(entities(F.col(f"{column}.labels"), F.col(f"{column}.offsets")), F.array().cast(_ENTITY)))
        entries.append(F.when(~failed("pii_ner"), pair("contains_personal_data", F.when(F.size("entities") > 0, 1.0).otherwise(0.0))))
    return df.withColumn("scores", F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def onnx_infer(path: str, threads: int = 1) -> Infer:
    """Runs an ONNX model over batches of ids and masks."""
    import numpy as np
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    session = onnxruntime.InferenceSession(path, options)
    inputs = [i.name for i in session.get_inputs()]

    def infer(ids: list[list[int]], masks: list[list[int]]) -> list:
        feeds = dict(zip(inputs, (np.array(x, dtype=np.int64) for x in (ids, masks)), strict=False))
        return np.asarray(session.run(None, feeds)[0], dtype=np.float64).tolist()

    return infer
