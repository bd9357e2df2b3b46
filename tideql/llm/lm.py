"""LM scoring: word counts of the whole corpus, and self-attention over subword ids.

A token's probability is that of its class given all subword ids of the text before it,
from the attention model, times that of the token within its class, (c + 1) / (N + V + 1)
over the class's training tokens. A class is the first subword id of a word, by a public
tokenizer; rarer first ids share one class and the end of a text is one of its own. The
last slot of a class stands for words that training has not seen. So the probabilities of
all known tokens and of one unknown word a class add up to one after any text.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.functions.shipping import ship
from tideql.llm import attention
from tideql.llm.common import LOWER, fields, keep_memory, remainder, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts are broadcast, at most: those of at least some level, the least that no
#: more words reach. A level is LEVELS times the binary logarithm of a word's training tokens,
#: rounded down. All other counts meet by a join.
HOT, LEVELS = 200_000, 8
#: Rounds of training on all executors at once, the steps' sizes in each, the windows that
#: one task of a round trains on, and the sets of weights that are added up in one task.
ROUNDS, RATES, TASK_WINDOWS, FAN = 3, (1.0, 0.6, 0.3), 1 << 16, 8
#: Positions scored together.
TOGETHER = 1 << 17
#: Characters of a word that the tokenizer gets at once: its time is not linear in their number.
STRETCH = 1024
#: Words up to so many bytes may be hot.
SHORT = 64
#: The end of a text as a token: no word holds a space.
END = b" "
#: Words that the tokenizer gets at once, and bytes of texts that are split together.
HELD, HELD_BYTES = 100_000, 1 << 23
REST_CLASS, END_CLASS = attention.CLASSES - 2, attention.CLASSES - 1
OTHER_LEAD = -1
#: What stands for the end of a text, and for a word without ids, among the positions.
END_ID, OTHER_ID = attention.IDS - 1, attention.IDS - 2


@functools.lru_cache(2)
def _encoding(digest: str, raw: bytes):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding(f"lead-{digest}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces_of(raw: bytes):
    """A function from a word's bytes to all its subword ids."""
    encode = _encoding(hashlib.sha256(raw).hexdigest()[:16], raw).encode_ordinary

    def pieces(word: bytes) -> list[int]:
        text = " " + word.decode("utf-8", "replace")
        if len(text) <= STRETCH:
            return encode(text)
        return [x for at in range(0, len(text), STRETCH) for x in encode(text[at : at + STRETCH])]

    return pieces


class Pieces:
    """All subword ids of many words at once."""

    def __init__(self, raw: bytes):
        self.encoding, self.one = _encoding(hashlib.sha256(raw).hexdigest()[:16], raw), pieces_of(raw)
        #: Whether an id's bytes begin with a space: only the first of a word's do.
        self.first = np.array([self.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.encoding.n_vocab)])

    def __call__(self, words: pa.Array):
        """(ids one after another, their number for each word) of a binary array. The words go
        to the tokenizer as one text, which it cuts before each space; long words, and those
        with other white space, at which it does not cut alone, go one by one."""
        if len(words) and pc.max(pc.binary_length(words)).as_py() <= STRETCH and not pc.any(pc.equal(words, END)).as_py():
            all_of_them = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            text = " " + pc.binary_join(all_of_them, b" ")[0].as_py().decode("utf-8", "replace")
            if len(text.split()) == len(words):
                ids = self.encoding.encode_to_numpy(text, disallowed_special=())
                begin = np.flatnonzero(self.first[ids])
                if len(begin) == len(words):
                    return ids.astype(np.uint16), np.diff(begin, append=len(ids))
        if len(words) > 64:  # what cannot be joined is set apart by halving
            half = len(words) // 2
            return tuple(np.concatenate(x) for x in zip(self(words[:half]), self(words[half:])))
        each = [[END_ID] if w == END else self.one(w) or [OTHER_ID] for w in words.to_pylist()]
        return np.array([x for y in each for x in y], np.uint16), np.array([len(x) for x in each], np.int64)


def lead_of(raw: bytes):
    """A function from a word's bytes to its first subword id."""
    pieces = pieces_of(raw)
    return lambda word: next(iter(pieces(word)), OTHER_LEAD)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    words = (text or b"").translate(LOWER).split()
    words.append(END)
    return words


def _together(texts: list, most: int = HELD_BYTES):
    """(start, end) of runs of texts of `most` bytes in all, or of one text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def coded(texts: list):
    """Of the tokens of many texts: (distinct words, number of each token's word among them, how
    many tokens each text has). The words are an Arrow array, the last of them the end."""
    joined = b"\n".join([t or b"" for t in texts] + [b""])
    at = np.frombuffer(joined, np.uint8)
    white = np.flatnonzero((at == 32) | (at - np.uint8(9) < 5))
    length = np.diff(white, prepend=-1) - 1
    some = np.flatnonzero(length)
    length, white = length[some], white[some]
    # white: the place behind each word; behind each text there is one more
    behind = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)).cumsum()
    last = np.searchsorted(white, behind)
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(LOWER, b"\t\n\v\f\r "))]
    words = pa.Array.from_buffers(pa.binary(), len(length), buffers).dictionary_encode()
    distinct = pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())])
    code = np.full(len(length) + len(texts), len(distinct) - 1, np.int32)
    within = np.ones(len(code), bool)
    within[last + np.arange(len(texts))] = False
    code[within] = words.indices.to_numpy()
    return distinct, code, np.diff(last, prepend=0) + 1


def counts(docs: DataFrame, raw: bytes) -> DataFrame:
    """(word, c, lead) over all texts of docs(text): every token's count, and its lead id."""

    def count(batches):
        keep_memory()
        for batch in batches:
            texts = fields(batch, "text")[0]
            for a, b in _together(texts):
                words, code, _ = coded(texts[a:b])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)), pa.int64())], ["word", "c"])

    def led(batches):
        keep_memory()
        pieces = Pieces(raw)
        for batch in batches:
            words = batch.column(0)
            leads = np.full(len(words), OTHER_LEAD, np.int32)
            for at in range(0, len(words), HELD):
                ids, n = pieces(words[at : at + HELD])
                first = ids[n.cumsum() - n].astype(np.int32)
                leads[at : at + HELD] = np.where(first >= OTHER_ID, OTHER_LEAD, first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leads, pa.int32())], ["word", "c", "lead"])

    each = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, c long")
    return written(each.groupBy("word").agg(F.sum("c").alias("c")).mapInArrow(led, "word binary, c long, lead int"), "counts")


class Classes:
    """Which class a lead id belongs to, and the classes' sizes."""

    def __init__(self, leads: list[tuple[int, int, int]], ends: int):
        """leads: (lead id, tokens, distinct words) without the end; ends: training texts."""
        order = sorted(leads, key=lambda r: (-r[1], r[0]))
        of = {r[0]: i for i, r in enumerate(order[:REST_CLASS])}
        self.tokens, self.words = np.zeros(attention.CLASSES), np.zeros(attention.CLASSES)
        for lead, n, distinct in leads:
            at = of.get(lead, REST_CLASS)
            self.tokens[at] += n
            self.words[at] += distinct
        self.tokens[END_CLASS], self.words[END_CLASS] = ends, min(1, ends)
        self.size = self.tokens + self.words + 1
        #: The class of a word by the first of its ids.
        self.by_id = np.full(attention.IDS, REST_CLASS, np.uint16)
        for lead, i in of.items():
            self.by_id[OTHER_ID if lead == OTHER_LEAD else lead] = i
        self.by_id[END_ID] = END_CLASS

    @property
    def prior(self) -> np.ndarray:
        return self.size / self.size.sum()


class Reader:
    """Turns texts into hot-word numbers and subword ids, on an executor."""

    def __init__(self, raw: bytes, hot: list[bytes]):
        self.pieces, self.words = Pieces(raw), pa.array(hot, pa.binary())
        self.hot = self.pieces(self.words)
        self.begin = self.hot[1].cumsum() - self.hot[1]

    def many(self, texts: list):
        """(distinct words, number of each token's word among them, hot number or -1 of each
        token, how many tokens each text has, subword ids of all tokens, how many each token has)."""
        words, code, n = coded(texts)
        number = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        cold = np.flatnonzero(number < 0)
        ids, size = self.pieces(words.take(pa.array(cold)))
        sizes = np.append(self.hot[1], 0)[number]
        sizes[cold] = size
        begin = np.append(self.begin, 0)[number]
        begin[cold] = len(self.hot[0]) + size.cumsum() - size
        each = sizes[code]
        behind = each.cumsum()
        place = np.repeat(begin[code] - behind + each, each)
        place += np.arange(len(place))
        return words, code, number[code], n, np.concatenate([self.hot[0], ids])[place], each

    def __call__(self, text: bytes | None):
        """Hot number or -1 of each token, the tokens that are not hot, all subword ids, and
        at which of them a token begins."""
        words, code, number, _, ids, each = self.many([text])
        starts = np.zeros(len(ids), bool)
        starts[each.cumsum() - each] = True
        return number, words.take(pa.array(code[number < 0])).to_pylist(), ids, starts


@functools.lru_cache(1)
def _reader(key: str, shared) -> Reader:
    return Reader(*shared.value[:2])


def _texts(batch: pa.RecordBatch):
    """(ids, starts) of each row."""
    for ids, bits in zip(*fields(batch, "ids", "starts")):
        ids = np.frombuffer(ids, np.uint16)
        yield ids, np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids)).astype(bool)


def read(docs: DataFrame, shared, key: str) -> DataFrame:
    """Each row of docs(doc_id, held_out, text) read once: its tokens as subword ids, the sum
    of its hot words' log counts, and its other words with their numbers."""

    def run(batches):
        keep_memory()
        reader, row = _reader(key, shared), TaskContext.get().partitionId() << 33
        log_count = np.log10(np.append(shared.value[2], 0.0) + 1)
        names = ["doc_id", "held_out", "row", "n_tokens", "n_known", "logs", "ids", "starts", "n_ids", "rare"]
        for batch in batches:
            texts = fields(batch, "text")[0]
            for a, b in _together(texts):
                words, code, number, n, ids, each = reader.many(texts[a:b])
                first = n.cumsum() - n
                n_ids = np.add.reduceat(each, first)
                behind = np.append(0, n_ids.cumsum())
                starts = np.zeros(len(ids), bool)
                starts[each.cumsum() - each] = True
                bits = [np.packbits(starts[i:j]).tobytes() for i, j in zip(behind.tolist(), behind[1:].tolist())]
                # the other words of each text, and how often they occur in it
                cold = np.flatnonzero(number < 0)
                pair, times = np.unique(np.repeat(np.arange(b - a), n)[cold] * len(words) + code[cold], return_counts=True)
                text, word = np.divmod(pair, len(words))
                pairs = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "times"])
                columns = [
                    batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                    batch.column("held_out").slice(a, b - a),
                    pa.array(np.arange(row, row + b - a), pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(np.add.reduceat(number >= 0, first, dtype=np.int64)),
                    pa.array(np.add.reduceat(log_count[number], first)),
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((2 * behind).astype(np.int32)), pa.py_buffer(ids)]),
                    pa.array(bits, pa.binary()),
                    pa.array(n_ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(b - a + 1)), pa.int32()), pairs),
                ]
                row += b - a
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, logs double, ids binary, starts binary, n_ids long, rare array<struct<word:binary,times:long>>"
    return written(docs.mapInArrow(run, schema), "read")


def _mean(models: DataFrame) -> dict[str, np.ndarray] | None:
    """The mean of the sets of weights in models(model, n), by n. FAN sets at a time meet in a
    task, and their sums again, until one is left: the driver gets one set whatever the input."""

    def add(batches):
        total, n = None, 0
        for batch in batches:
            for raw, k in zip(*fields(batch, "model", "n")):
                part = np.frombuffer(raw, np.float32).astype(np.float64) * k
                total, n = part if total is None else total + part, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["model", "n"])

    models = written(models, "models")
    left = models.count()
    while left > 1:
        left = -(-left // FAN)
        models = models.repartition(left).mapInArrow(add, "model binary, n long")
        models = written(models, "models") if left > 1 else models
    one = models.first() if left else None
    return attention.unpacked(one["model"]) if one else None


def trained(texts: DataFrame, classes: Classes) -> dict[str, np.ndarray]:
    """Attention weights, learnt from all of texts(row, ids, starts, n_ids), each once. The
    rows are dealt to ROUNDS rounds; in each round every task trains on its rows from the
    weights so far, and the mean of the results, by windows seen, goes on. There are as many
    tasks as the rows make up TASK_WINDOWS windows."""
    model, session = attention.initial(classes.prior), texts.sparkSession
    by_id = session.sparkContext.broadcast(classes.by_id)
    for at in range(ROUNDS):
        mine = texts.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == at)
        windows = mine.agg(F.sum(F.ceil((F.col("n_ids") + 1) / attention.WIDTH))).first()[0] or 0
        start = session.sparkContext.broadcast(attention.packed(model))

        def learn(batches, start=start, at=at):
            keep_memory()
            trainer = attention.Trainer(attention.unpacked(start.value), 1000 * at + TaskContext.get().partitionId(), attention.RATE * RATES[at])
            for batch in batches:
                for ids, starts in _texts(batch):
                    trainer.add(ids, by_id.value[ids[starts]], starts)
            trainer.train()
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([attention.packed(trainer.model)], pa.binary()), pa.array([trainer.seen], pa.int64())], ["model", "n"])

        tasks = max(1, -(-int(windows) // TASK_WINDOWS))
        model = _mean(mine.select("ids", "starts").coalesce(tasks).mapInArrow(learn, "model binary, n long")) or model
    return model


def scored(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    docs(doc_id, text). Rows whose crc32(doc_id) remainder by 7 is 2 are held out, all others
    are learnt from. A null id counts as the empty text, a null text as empty: its only token
    is the end. Repeated rows each count and each give a row. Very long texts are read as a
    whole and scored some windows at a time. Without training rows every token is unknown,
    and the model predicts its untrained prior. An empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        raw = f.read()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 7) == 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    known = counts(docs.where(~F.col("held_out")), raw)
    ends = known.where(F.col("word") == F.lit(END)).select("c").first()
    # at most one row for each id of the vocabulary
    leads = known.where(F.col("word") != F.lit(END)).groupBy("lead").agg(F.sum("c").alias("n"), F.count("*").alias("words")).collect()
    classes = Classes([(r["lead"], r["n"], r["words"]) for r in leads], ends["c"] if ends else 0)
    n, v = int(classes.tokens.sum()), int(classes.words.sum())
    short = F.octet_length("word") <= SHORT
    level = F.floor(F.log2("c") * LEVELS).cast("int")
    # one row for each level: at most 64 * LEVELS
    reach = dict(known.where(short & (F.col("c") > 1)).groupBy(level).count().collect())
    least, words = 64 * LEVELS, 0
    for k in sorted(reach, reverse=True):
        words += reach[k]
        if words > HOT:
            break
        least = k
    is_hot = short & (level >= least)
    hot = sorted((bytes(r["word"]), r["c"]) for r in known.where(is_hot).select("word", "c").collect())
    shared = spark.sparkContext.broadcast((raw, [w for w, _ in hot], np.array([c for _, c in hot], float)))
    key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)}"
    rows = read(docs, shared, key)
    model = trained(rows.where(~F.col("held_out")).select("row", "ids", "starts", "n_ids"), classes)
    weights = spark.sparkContext.broadcast((attention.packed(model), classes.by_id, np.log10(classes.size)))

    def score(batches):
        keep_memory()
        packed, by_id, log_size = weights.value
        scorer = attention.Scorer(attention.unpacked(packed))
        for batch in batches:
            fit, parts, held = np.zeros(batch.num_rows), [], 0

            def flush():
                inputs, target, mask, owner = (np.concatenate(x) for x in zip(*parts))
                fit[: owner[-1] + 1] += np.bincount(owner, scorer(inputs, target, mask) - log_size[target[mask]], owner[-1] + 1)
                parts.clear()

            for i, (ids, starts) in enumerate(_texts(batch)):
                for one in attention.streams(ids, by_id[ids[starts]], starts, TOGETHER):
                    parts.append((*one, np.full(int(one[2].sum()), i)))
                    held += len(one[0])
                    if held >= TOGETHER:
                        flush()
                        held = 0
            if parts:
                flush()
            names = ["doc_id", "held_out", "row", "n_tokens", "n_known", "logs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fit)], [*names, "fit"])

    heads = rows.select("doc_id", "held_out", "row", "n_tokens", "n_known", "logs", "ids", "starts").mapInArrow(
        score, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, logs double, fit double"
    )
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(known.where(~is_hot).select("word", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return heads.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (logs + F.col("fit")).alias("score"),
    )


def query(spark, sf_dir):
    """Scores of all documents."""
    return scored(table(spark, sf_dir, "documents"))
