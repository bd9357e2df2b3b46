"""Token counts by a Viterbi search that carries counts, not pieces.

An Aho-Corasick automaton over a unigram vocabulary lists every piece that ends at each
place of a word. The search keeps, for each place, the best score of a segmentation that
ends there and its number of tokens. Ties follow the tokenizer's lattice search: at each
end the piece that starts first wins, later ones only with a strictly better score.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.functions.shipping import ship
from tideql.llm.common import fields, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: An unknown character costs the least score of the vocabulary less this much.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a worker remembers in each of two generations; longer words
#: are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64
SPACE = "▁"


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class TokenCounter:
    """Counts the tokens of words; unknown characters fall back to their UTF-8 bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word, the mark of its beginning included."""
        text = SPACE + word
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, top, tokens, single = 0, None, 0, False
        # matches come by their ends, and of one end the longest first
        for end, (length, score) in self.automaton.iter(text):
            while at < end:
                if not single:
                    top, tokens = self.or_unknown(text[at], best[at], count[at], top, tokens)
                at += 1
                best[at], count[at] = top, tokens
                top, single = None, False
            got = best[end + 1 - length] + score
            if top is None or got > top:
                top, tokens = got, count[end + 1 - length] + 1
            if length == 1:
                single = True
        while at < n:
            if not single:
                top, tokens = self.or_unknown(text[at], best[at], count[at], top, tokens)
            at += 1
            best[at], count[at] = top, tokens
            top, single = None, False
        return count[n]

    def or_unknown(self, char: str, before: float, n: int, top: float | None, tokens: int):
        """The better of what ends here and an unknown character, counted as its bytes."""
        got = before + self.unknown
        return (got, n + len(char.encode("utf-8", "surrogatepass"))) if top is None or got > top else (top, tokens)

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = Counter((text or "").encode("utf-8", "surrogatepass").split())
        known, n, tokens = self.known, 0, 0
        for word, times in words.items():
            got = known.get(word)
            if got is None:
                got = self.older.get(word)
                if got is None:
                    got = self.word(word.decode("utf-8", "surrogatepass"))
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        self.older, self.known = known, {}
                        known = self.known
                    known[word] = got
            n += times
            tokens += got * times
        return n, tokens


@functools.lru_cache(2)
def _built(digest: str, pieces: tuple) -> TokenCounter:
    return TokenCounter(list(pieces))


def counted(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs(doc_id, text).

    Words are runs without ASCII white space; each is segmented on its own behind a mark of
    its beginning. Null and empty texts have no tokens. Rows with a null doc_id and repeated
    rows each give a row. An empty table gives an empty result. The vocabulary, of fixed
    size, is the only thing broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))
    digest = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def run(batches):
        counter = _built(digest, shared.value)
        for batch in batches:
            ids, texts = fields(batch, "doc_id", "text")
            got = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir):
    """Token counts of all documents under the unigram vocabulary of MODEL."""
    return counted(table(spark, sf_dir, "documents"), vocabulary())
