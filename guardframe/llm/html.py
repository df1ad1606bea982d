"""Main text of web pages by equivalence-class template deduction.

Every element of a page (named by its path of tags and classes) and every
block of text is a token. Over the pages of a host, tokens with the same
occurrence vector, that is, with the same counts page by page, form an
equivalence class; a vector is known by its sums. A host's pages are dealt to
layouts first: elements that hold most of the text of the pages they are on
nest by their paths, and a page belongs to the innermost that splits no
further. Over the pages of a layout, the classes that most pages share make
the template, and classes of elements and the blocks in them are its optional
parts. What is left are slots: the element that occurs once a page and under
which most of the changing text lies is the root of the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.llm.common import materialise, released, slices

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements, and words in a class, id or role, of what isn't the article.
ASIDE_TAGS = frozenset("head nav footer aside form menu dialog script style noscript template iframe svg math canvas object audio video button select input textarea option datalist noembed noframes xmp title".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr legal menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets complementary contentinfo dialog search form masthead skip".split()
)
HEADER_WORDS = frozenset("header banner masthead".split())
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset(("articlebody", "main"))
#: What the name of the outermost marked element ends in; no tag or class holds a blank.
MARK = " main"

#: A tag ends at the first > outside quotes; a quote that nothing closes is a character like others.
#: No part gives back what it took, so a page is read once.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A template token is on this share of its layout's pages, and on so many pages, at least.
SHARE, PAGES = 0.5, 3
#: Bytes of a written table that is broadcast at most; beyond, the same join is shuffled.
BROADCAST_BYTES = 16 << 20
#: (host, token) sums that a task holds before it passes them on.
HELD = 200_000
#: Levels of open elements; deeper ones stand beside each other, as in browsers.
DEEPEST = 256
#: Characters of an element's name in a path; longer ones are known by their hash.
NAME = 200
_PLAIN_NAME = str.maketrans(">=", "__")


class Block:
    """A block of text: its path, whether it stands outside the article, and inside a marked main element."""

    __slots__ = ("aside", "main", "path", "text", "wraps")

    def __init__(self, path: str, aside: bool, main: bool, text: str, wraps: tuple[int, ...] = ()):
        self.path, self.aside, self.main, self.text, self.wraps = path, aside, main, text, wraps


def _unwrap(blocks: list[Block]) -> None:
    """Ends an aside that is only a wrapper: one known by its words, or a form, that holds a main
    element with at least half of the text outside other asides, or all of that text."""
    size: dict[int, int] = defaultdict(int)
    inner: dict[int, int] = defaultdict(int)
    open_ = [b for b in blocks if not b.aside]
    total = sum(len(b.text) for b in open_)
    for b in open_:
        for w in b.wraps:
            size[w] += len(b.text)
            inner[w] += len(b.text) if b.main else 0
    lifted = {w for w, n in size.items() if 2 * inner[w] >= total or n == total}
    for b in open_:
        b.aside = any(w not in lifted for w in b.wraps)


def _closes(tag: str, open_tag: str) -> bool:
    """Whether a start tag ends an open element whose end tag HTML lets one leave out."""
    if open_tag == "p":
        return tag in BLOCK
    return (tag, open_tag) in _SIBLINGS or tag == open_tag and tag in ("li", "option", "tr", "td", "th", "dt", "dd")


#: Start tag and the open element that it ends.
_SIBLINGS = frozenset([("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td"), ("tr", "td"), ("tr", "th"), ("tbody", "thead"), ("tfoot", "tbody"), ("body", "head")])


def parse(page: str | None) -> tuple[list[str], list[Block]]:
    """Paths of the page's elements, and its blocks of text, in page order."""
    paths: list[str] = []
    blocks: list[Block] = []
    # An open element: tag, path, aside, main, and whether it stands aside within a block (its text is left out).
    # Last, the numbers of the elements that are aside by their words or as a form.
    stack: list[tuple[str, str, bool, bool, bool, tuple[int, ...]]] = [("", "", False, False, False, ())]
    known: dict[tuple[str, str], str] = {}
    held: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(Block(owner[1], owner[2], owner[3], text, owner[5]))

    def say(text: str) -> None:
        nonlocal owner
        if stack[-1][4]:
            return
        if not held:
            owner = next(x for x in reversed(stack) if x[0] in BLOCK or not x[0])
        held.append(text)

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower().translate(_PLAIN_NAME)
        if not tag:
            continue
        if closing:
            if tag == "br":
                say(" ")
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                if any(x[0] in BLOCK for x in stack[depth:]):
                    flush()
                del stack[depth:]
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if _closes(tag, stack[k][0]):
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in ("p", "dd", "dt", "td", "th"):
                    break
        elif tag == "br":
            say(" ")
        _, _, aside, main, muted, wraps = stack[-1]
        if len(stack) > DEEPEST:
            if stack[-1][0] in BLOCK:
                flush()
            stack.pop()
        words, name = set(), tag
        for key, *values in _ATTRIBUTE.findall(m.group(3) or ""):
            value = next((v for v in values if v), "").lower()
            words |= set(value.split())
            if key.lower() == "class" and value.split():
                name += "." + ".".join(sorted(value.split())).translate(_PLAIN_NAME)
            if value.strip() in MAIN_WORDS or key.lower() == "itemprop" and value == "articlebody":
                main = True
        main = main or tag in MAIN_TAGS
        if len(name) > NAME:
            name = f"{tag[:NAME]}.{_digest(name)}"
        if main and not stack[-1][3]:
            name += MARK
        soft = tag == "form" or bool(words & ASIDE_WORDS) and tag not in ("html", "body", *MAIN_TAGS)
        out = tag in ASIDE_TAGS and tag != "form" or (tag == "header" or bool(words & HEADER_WORDS)) and not main
        if soft and not out:
            wraps = (*wraps, len(paths))
        above = stack[-1][1]
        path = known.get((above, name))
        if path is None:
            path = known[above, name] = f"{above}>{name}" if above else name
        paths.append(path)
        muted = muted or (out or soft) and not aside and tag not in BLOCK
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = len(page) if end is None else end.end()
        elif tag not in VOID and not (m.group(3) or "").rstrip().endswith("/"):
            stack.append((tag, path, aside or out, main, muted, wraps))
        elif tag not in VOID and tag in BLOCK:
            flush()
    flush()
    _unwrap(blocks)
    return paths, blocks


def _digest(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _text_token(block: Block) -> str:
    return f"{block.path}={_digest(block.text)}"


def _inside(path: str, top: str) -> bool:
    """Whether a path is that of an element or lies below it."""
    return path.startswith(top) and path[len(top) : len(top) + 1] in ("", ">")


def page_tokens(parsed: tuple[list[str], list[Block]]) -> dict[str, tuple[int, int]]:
    """Each token's count on a parsed page, and the characters of article text below or in it.

    The empty token is the page itself.
    """
    paths, blocks = parsed
    counts: dict[str, int] = defaultdict(int)
    chars: dict[str, int] = defaultdict(int)
    for path in paths:
        counts[path] += 1
    own: dict[str, int] = defaultdict(int)
    for block in blocks:
        if not block.aside:
            token = _text_token(block)
            counts[token] += 1
            chars[token] += len(block.text)
            own[block.path] += len(block.text)
    total = sum(own.values())
    for path, n in own.items():
        while path:
            chars[path] += n
            path = path.rpartition(">")[0]
    return {"": (1, total)} | {t: (n, chars.get(t, 0)) for t, n in counts.items()}


_HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str):
    """Column: a URL's host in small letters, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """(``host``, ``layout``, ``token``) with ``pages``, ``times``, ``chars``, ``all`` (the pages'
    characters) and ``vector``, the sum over pages of a hash of (page, count): equal vectors
    have equal sums. With ``layouts`` in the pages, each page counts under its own;
    without, only elements are counted, under the empty one.

    Summed within each task first, so a host with most of the pages costs no task more.
    """
    dealt = "layouts" in pages.columns
    schema = "host string, layout string, token string, pages long, times long, chars long, all long, vector long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[tuple[str, str, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], pa.string()) for i in range(3)] + [pa.array([v[i] for v in held.values()], pa.int64()) for i in range(5)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, "html"):
            layouts = batch.column("layouts").to_pylist() if dealt else [None] * batch.num_rows
            for host, key, page, known in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html")), layouts, strict=True):
                parsed = parse(page)
                tokens = page_tokens(parsed)
                layout, total = layout_of(parsed[0], known), tokens[""][1]
                for token, (n, chars) in tokens.items():
                    if not dealt and "=" in token:
                        continue
                    one = held.setdefault((host, layout, token), [0, 0, 0, 0, 0])
                    one[0] += 1
                    one[1] += n
                    one[2] += chars
                    one[3] += total
                    one[4] += xxhash.xxh32_intdigest(f"{key}:{n}")
            if len(held) > HELD:
                yield flush()
        yield flush()

    sums = [F.sum(c).alias(c) for c in names[3:]]
    return pages.mapInArrow(released(run), schema).groupBy("host", "layout", "token").agg(*sums)


def layout_of(paths: list[str], layouts: list[str] | None) -> str:
    """The innermost of the host's layouts that is on the page once, empty if none is."""
    if not layouts:
        return ""
    known = set(layouts)
    found = Counter([p for p in paths if p in known])
    return max((p for p, n in found.items() if n == 1), key=lambda p: (p.count(">"), p), default="")


def nest(candidates: list[tuple[str, int]]) -> list[str]:
    """A host's layouts from its elements (path, pages) that hold most of the text of their pages.

    They nest by path. An element whose innermost candidates below share out
    most of its pages stands for several layouts, or a narrower one; otherwise
    it is a layout itself, and what lies below is an optional part of it.
    """
    pages = dict(candidates)
    below: dict[str, list[str]] = defaultdict(list)
    for path in pages:
        parts = path.split(">")
        above = (">".join(parts[:k]) for k in range(len(parts) - 1, 0, -1))
        below[next((p for p in above if p in pages), "")].append(path)
    out, left = [], list(below[""])
    while left:
        path = left.pop()
        if sum(pages[p] for p in below[path]) >= SHARE * pages[path]:
            left += below[path]
            if sum(pages[p] for p in below[path]) == pages[path]:
                continue
        out.append(path)
    return sorted(out)


def layouts(pages: DataFrame) -> DataFrame:
    """(``host``, ``layouts``): the elements, once on each of their pages, that hold most of the
    text of these pages, whatever share of the host's pages they are."""
    share = F.when(F.col("token").endswith(MARK), 0.5).otherwise(0.9)
    found = occurrences(pages).where((F.col("token") != "") & (F.col("pages") >= PAGES) & (F.col("times") == F.col("pages")) & (F.col("chars") > 0) & (F.col("chars") >= share * F.col("all")))
    gathered = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "pages"))).alias("tokens"))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("layouts", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [nest([tuple(t.values()) for t in tokens]) for tokens in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(said, pa.list_(pa.string()))], names=schema.names)

    return materialise(gathered.mapInArrow(released(run), schema), "layouts")


def deduce(tokens: list[tuple[str, int, int, int, int]], pages: int) -> tuple[str, list[str]]:
    """A layout's template from its tokens (token, pages, times, chars, vector): the path of
    the main text's root (empty if none stands out) and the constant blocks.

    Blocks are constant if nearly all pages have them once, or if their class
    (equal vectors) has an element around them: an optional part of the template.
    """
    classes: dict[tuple[int, int, int], list[tuple[str, int]]] = defaultdict(list)
    for token, on, times, chars, vector in tokens:
        classes[on, times, vector].append((token, chars))
    elements = [(t, c) for (on, times, _), members in classes.items() if on == times and on >= SHARE * pages for t, c in members if t and "=" not in t]
    total = max((c for _, c in elements), default=0)
    # Nested: each once-a-page element with its once-a-page descendants; the innermost that still has most of the text.
    # A marked element needs half of it only.
    inner = [t for t, c in elements if total and c >= (0.5 if t.endswith(MARK) else 0.9) * total]
    root = max(inner, key=lambda t: (t.count(">"), t), default="")
    constant: dict[str, int] = {}
    for (on, times, _), members in classes.items():
        if on != times or on < PAGES:
            continue
        around = {t for t, _ in members if "=" not in t}
        for token, chars in members:
            if "=" in token:
                parts = token.rsplit("=", 1)[0].split(">")
                if on >= 0.8 * pages or any(">".join(parts[:k]) in around for k in range(1, len(parts) + 1)):
                    constant[token] = chars
    if total and sum(c for t, c in constant.items() if t.startswith((f"{root}>", f"{root}="))) >= max(c for t, c in elements if t == root):
        constant = {}  # the pages are copies of each other: no slot to tell the template from
    return root, sorted(constant)


def templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(``host``, ``layout``, ``root``, ``constant``) for each layout with enough pages.

    Tokens with equal vectors are gathered as one class; all members are on the
    same pages, so a page bounds their number. A class is valid if most of its
    layout's pages share it, or if it has elements and blocks and its blocks are
    the lesser part of its pages' text; otherwise its pages are copies.
    """
    keys = ("host", "layout")
    counted = materialise(occurrences(pages.join(found, "host", "left")).where(F.col("pages") >= PAGES), "occurrences")
    whole = counted.where(F.col("token") == "").select(*keys, F.col("pages").alias("whole"))
    block = F.contains("token", F.lit("="))
    member = F.struct("token", "pages", "times", "chars", "vector")
    classes = counted.groupBy(*keys, "pages", "times", "vector").agg(F.max(block).alias("blocks"), F.min(block).alias("bare"), F.sum(F.when(block, F.col("chars"))).alias("fixed"), F.max("all").alias("all"), F.collect_list(member).alias("members"))
    optional = F.col("blocks") & ~F.col("bare") & (F.col("times") == F.col("pages")) & (F.col("fixed") < 0.5 * F.col("all"))
    valid = classes.join(whole, [*keys]).where((F.col("pages") >= SHARE * F.col("whole")) | optional)
    gathered = valid.groupBy(*keys).agg(F.max("whole").alias("whole"), F.sort_array(F.flatten(F.collect_list("members"))).alias("tokens"))
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in (*keys, "root")), T.StructField("constant", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [deduce([tuple(t.values()) for t in row["tokens"]], row["whole"]) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array([f[0] for f in said], pa.string()), pa.array([f[1] for f in said], pa.list_(pa.string()))], names=schema.names)

    return materialise(gathered.mapInArrow(released(run), schema), "templates")


def main_text(page: str | None, root: str | None, constant: frozenset[str]) -> str:
    """The page's slots below the template's root, without what stands aside and without the
    constant blocks. A marked main element counts only where no root is known or on the page."""
    return slots(parse(page)[1], root, constant)


def slots(blocks: list[Block], root: str | None, constant: frozenset[str]) -> str:
    """The main text of a parsed page, as ``main_text``. A page of constant blocks only keeps them."""
    own = [b for b in blocks if not b.aside]
    below = [b for b in own if _inside(b.path, root)] if root else []
    own = below or [b for b in own if b.main] or own
    return "\n\n".join(b.text for b in [b for b in own if _text_token(b) not in constant] or own)


def _sized(written: DataFrame) -> int:
    """Bytes of a written table, as its files have them."""
    return int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _counted(pages: DataFrame) -> DataFrame:
    """The pages that templates are counted over: of a host's pages with equal html, one."""
    known = pages.withColumn("content", F.xxhash64("html")).withColumn("row", F.monotonically_increasing_id())
    copies = materialise(known.groupBy("host", "content").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").select("host", "content", "first"), "copies")
    few = _sized(copies) <= BROADCAST_BYTES
    found = known.join(F.broadcast(copies) if few else copies, ["host", "content"], "left")
    return found.where(F.col("first").isNull() | (F.col("row") == F.col("first"))).select("host", "key", "html")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text``: the blocks of the main text joined by blank lines.

    A null or empty page has an empty text; a null or odd URL belongs to the host
    with the empty name; repeated rows each give a row, and count once for the
    template, as do all pages with equal html; all other columns pass through,
    whatever their names, but for one called ``text``, which is replaced. Templates
    are broadcast if their tables are small, and joined by host otherwise.
    """
    own = [c for c in pages.columns if c not in (html, "text")]
    host = host_of(url)
    inputs = _counted(pages.select(host.alias("host"), F.col(key).cast("string").alias("key"), F.col(html).alias("html")))
    found = layouts(inputs)
    few = _sized(found) <= BROADCAST_BYTES
    found = F.broadcast(found) if few else found
    deduced = templates(inputs, found)
    few = few and _sized(deduced) <= BROADCAST_BYTES
    by_layout = deduced.groupBy("host").agg(F.collect_list(F.struct("layout", "root", "constant")).alias("templates"))
    known = by_layout.join(found, "host", "left")
    # The own columns travel in one, so that none of their names can clash.
    kept = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), host.alias("host"), F.col(html).alias("html"))
    joined = kept.join(F.broadcast(known) if few else known, "host", "left").select("own", "html", "templates", "layouts")
    schema = T.StructType([*(pages.schema[c] for c in own), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for page, every, names in zip(*(batch.column(c).to_pylist() for c in ("html", "templates", "layouts")), strict=True):
                paths, blocks = parse(page)
                layout = layout_of(paths, names)
                root, constant = next(((t["root"], t["constant"]) for t in every or () if t["layout"] == layout), (layout, ()))
                texts.append(slots(blocks, root or layout, frozenset(constant)))
            yield pa.RecordBatch.from_arrays([*batch.column("own").flatten(), pa.array(texts, pa.string())], names=[*own, "text"])

    return joined.mapInArrow(released(run), schema)
