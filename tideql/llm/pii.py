"""Personal data: exact patterns, and a character-level tagger for disguised forms."""

from __future__ import annotations

import hashlib
import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.functions.shipping import ship
from tideql.llm import tagger
from tideql.llm.common import fields, table
from tideql.llm.tagger import KINDS, luhn

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its beginning only: what fails there fails at every later digit too
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_EITHER = re.compile(r"[0-9@]")

Span = tuple[int, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain, found from the at signs."""
    got, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            got.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return got


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _n_digits(part: str) -> int:
    return sum(map(part.count, "0123456789"))


def _is_card(part: str) -> bool:
    return 13 <= _n_digits(part) <= 19 and luhn("".join(_NUMBER.findall(part)))


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) by the patterns; by kind, then start; code points, end exclusive."""
    text = text or ""
    if not _EITHER.search(text):
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    spans += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= _n_digits(m[0]) <= 15]
    return spans


#: Characters around what the tagger marked in which an address may go on.
REACH = 200
_HEAD = re.compile(r"[0-9a-z._%+-]+ ?[(\[]? ?(?P<at>@|(?<=[ (\[])at(?=[ )\]])) ?[)\]]? ?[0-9a-z-]+(?= ?[(\[]?(?:\.|(?<=[ (\[])dot(?=[ )\]]))[)\]]? ?[0-9a-z-])", re.IGNORECASE)
_TIGHT = re.compile(r"\.[0-9a-z-]+", re.IGNORECASE)
_LOOSE = re.compile(r" ?[(\[]?(?:\.|(?<=[ (\[])dot(?=[ )\]]))[)\]]? ?[0-9a-z-]+", re.IGNORECASE)
_BREAK = re.compile(r"[^\W\d_]|\n")
_DOTS = re.compile(r"(?i)(?<![a-z])dot(?![a-z])")


def _address(text: str, a: int, b: int) -> Span | None:
    """The address, spelled out or not, whose at sign lies in text[a:b]: from the first
    character of its local part, over all domain parts that follow closely, and over looser
    ones that begin before b."""
    low = max(0, a - REACH)
    part = text[low : b + REACH]
    for m in _HEAD.finditer(part):
        if not a <= low + m.start("at") < b:
            continue
        end = m.end()
        while more := _TIGHT.match(part, end) or (_LOOSE.match(part, end) if end == m.end() or b - low > end + 1 else None):
            end = more.end()
        return (0, low + m.start(), low + end)
    return None


def _is_ip(part: str, numbers: list[str]) -> bool:
    return len(numbers) == 4 and all(map(_byte, numbers)) and not _BREAK.search(_DOTS.sub("", part))


def _is_number(part: str, numbers: list[str]) -> bool:
    return not _BREAK.search(part) and _is_card(part)


def _is_phone(part: str, numbers: list[str]) -> bool:
    return not _BREAK.search(part) and 9 <= _n_digits(part) <= 15 and (part[0] in "+(0" or len(numbers) >= 3) and len(numbers) <= 6 and max(map(len, numbers)) <= 12


_CHECKS = {1: (_is_ip, 4), 2: (_is_number, 19), 3: (_is_phone, 6)}


def settled(kind: int, text: str, a: int, b: int) -> Span | None:
    """What the tagger marked as text[a:b], mended at its edges, or None if it cannot be of
    its kind at all. An address reaches as far as its form does; of the numbers marked, whole
    ones, the longest run counts that is of the kind, the first of equally long ones."""
    if kind == 0:
        return _address(text, a, b)
    if not _NUMBER.search(text, a, b):
        return None
    while a > 0 and text[a - 1] in "0123456789":
        a -= 1
    while b < len(text) and text[b] in "0123456789":
        b += 1
    at, (check, most), best = [m.span() for m in _NUMBER.finditer(text, a, b)], _CHECKS[kind], None
    for i, (first, _) in enumerate(at):
        if kind == 3:
            first -= first > 0 and text[first - 1] in "+("
        for _, last in at[i : i + most]:
            if (best is None or last - first > best[2] - best[1]) and check(part := text[first:last], _NUMBER.findall(part)):
                best = (kind, first, last)
    return best


def all_spans(texts: list[str | None], model: tagger.Tagger, every: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. All spans are the base ones and the tagger's,
    settled, that reach beyond the base ones they meet; by kind, then start. every: decode
    all windows, not only those in which a span can be; the result is the same."""
    texts = [t or "" for t in texts]
    got = []
    for text, more in zip(texts, tagger.found_in(model, texts, settled, every)):
        base = base_spans(text)
        if base and more:
            more = [s for s in more if not _covered(base, s)]
        got.append((base, sorted(base + more)))
    return got


def _covered(base: list[Span], span: Span) -> bool:
    """Whether base spans, taken together, hold all of a span."""
    at = span[1]
    for _, a, b in sorted((s for s in base if s[1] < span[2] and span[1] < s[2]), key=lambda s: s[1]):
        if a > at:
            return False
        at = max(at, b)
    return at >= span[2]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_models: dict[int, tagger.Tagger] = {}


def trained(spark, seed: int = tagger.SEED) -> tagger.Tagger:
    """The tagger, trained once a process in one task of its own; the same on every run."""
    if seed not in _models:
        ship(spark)

        def run(batches):
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger.trained(seed).w)], pa.binary())], ["w"])

        raw = spark.range(0, 1, 1, 1).mapInArrow(run, "w binary").first()["w"]
        _models[seed] = tagger.Tagger(seed)
        _models[seed].w = pickle.loads(bytes(raw))
    return _models[seed]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs(doc_id, text).

    Counts and base_sha256 are of the pattern matches; spans lists all spans, those of the
    tagger added. Null texts count as empty and have no spans. Very long texts are decoded
    window by window, some thousands at a time. Rows with a null doc_id and repeated rows
    each give a row. An empty table gives an empty result."""
    ship(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(trained(docs.sparkSession))  # a fixed size

    def run(batches):
        for batch in batches:
            ids, texts = fields(batch, "doc_id", "text")
            found = all_spans(texts, weights.value)
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([_joined(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span's kind in its place; spans that overlap become one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with personal data replaced by the names of its kinds
    and n_chars, where there is one, the new length. Null texts stay null."""
    ship(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(trained(docs.sparkSession))
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = fields(batch, "text")[0]
            new = [None if t is None else masked(t, every) if every else t for t, (_, every) in zip(texts, all_spans(texts, weights.value))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else c for n, c in zip(names, batch.columns)], names)

    rows = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return rows


def query(spark, sf_dir):
    """Personal data in all documents."""
    return marked(table(spark, sf_dir, "documents"))
