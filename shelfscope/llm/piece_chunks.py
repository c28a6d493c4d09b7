"""SentencePiece ids by a table of distinct marked words.

No piece of the model crosses from a word into the next whitespace marker, so the segmentation of a text
is the concatenation of the segmentations of its marked words: a run of markers and what follows up to
the next one.  Each distinct marked word is segmented once and its ids put back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage, most_frequent, present

# Distinct marked words that go to all tasks; the rest is segmented where it stands.
HEAD_WORDS = 1 << 17
_GROUP = 1000  # texts whose rare words are segmented together
_MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")


@lru_cache(maxsize=2)
def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=2)
def separable(model: str) -> bool:
    """Whether no piece has a marker behind another character, and text is neither normalised nor trimmed."""
    sp = _processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    inside = any(_MARK in p.lstrip(_MARK) for p in pieces)
    probe = "  a ﬁ  B "
    return not inside and sp.decode(sp.encode(probe)) == probe


def _words(text: str) -> list[str]:
    """Marked words of a text without their first marker; empty text has none."""
    if not text:
        return []
    text = text.replace(_MARK, " ")
    if "  " in text or text[0] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ")


def chunks(text: str) -> list[str]:
    """Marked words of a text, each with its markers as spaces; empty text has none."""
    return [" " + w for w in _words(text)]


def segment(model: str, words: list[str]) -> list[list[int]]:
    """Ids of marked words given without their first marker, which the library adds itself."""
    sp = _processor(model)
    lone = [sp.piece_to_id(_MARK)]
    return [ids if w else lone for w, ids in zip(words, sp.encode(words, num_threads=1))]


def chunk_table(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The distinct marked words of all texts: ``chunk, n, ids``, each segmented once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(_words(t))
            yield pa.RecordBatch.from_pydict({"chunk": [" " + w for w in seen], "n": pa.array(seen.values(), pa.int64())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c[1:] for c in batch.column(0).to_pylist()]
            ids = pa.array(segment(model, words), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["chunk", "n", "ids"])

    counted = docs.select(text).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "chunk string, n long, ids array<int>")


Row = tuple[int, str, str]  # number of ids, the ids as text, the decoded text


def _rows(model: str, words: list[str], ids: list[list[int]]) -> dict[str, Row]:
    """Per word, without its first marker, its ids and the text decoded from them, marker included."""
    decoded = _processor(model).decode(ids, num_threads=1) if ids else []
    return {w: (len(i), " ".join(map(str, i)), " " + d) for w, i, d in zip(words, ids, decoded)}


class _Texts:
    """Encoder of whole texts; ``head`` holds the rows of words that need no segmenting, by word."""

    def __init__(self, model: str, head: dict[str, Row]):
        self.model, self.table = model, dict(head)

    def whole(self, texts: list[str]) -> list[Row]:
        sp = _processor(self.model)
        ids = [sp.encode(t, num_threads=1) for t in texts]
        return [(len(i), " ".join(map(str, i)), sp.decode(i)) for i in ids]

    def joined(self, texts: list[str]) -> list[Row]:
        """Each text's words looked up and put together; words outside the table are segmented once for all texts."""
        split = [_words(t) for t in texts]
        rare = list(set().union(*split).difference(self.table))
        rest = _rows(self.model, rare, segment(self.model, rare)) if rare else {}
        find, out = self.table.get, []
        for words in split:
            n, ids, decoded = zip(*[find(w) or rest[w] for w in words]) if words else ((), (), ())
            out.append((sum(n), " ".join(ids), "".join(decoded)[1:]))
        return out


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text",
                     head_words: int = HEAD_WORDS, keep_text: bool = False) -> DataFrame:
    """Ids of each whole text with an end id, and the text decoded from them.

    The table of distinct marked words covers all texts.  Its ``head_words`` most frequent rows, a bound
    that does not grow with the corpus, go to all tasks and are put back by position.  Rarer words are
    segmented where they stand, once for each group of texts: shipping a word to a table and its ids back
    costs two shuffles of nearly the whole corpus.  A model whose pieces cross markers, or that normalises,
    encodes whole texts instead.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_text``, ``ids`` and
    ``decoded``.  A null or empty text has the end id only and decodes to nothing; texts of any length
    are taken whole; repeated rows and null ids keep their rows; other columns are dropped.
    """
    split = separable(model)
    head: dict[str, Row] = {}
    if split:
        top = most_frequent(cut_lineage(chunk_table(docs, model, text)), head_words)
        head = _rows(model, [r.chunk[1:] for r in top], [r.ids for r in top])
    shared = docs.sparkSession.sparkContext.broadcast(head)
    eos = _processor(model).eos_id()
    schema = f"{doc_id} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_text:
        schema += ", ids string, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(model, shared.value)
        encode = texts.joined if split else texts.whole
        for batch in (b.slice(i, _GROUP) for b in batches for i in range(0, b.num_rows, _GROUP)):
            rows = []
            for n, ids, decoded in encode(present(batch.column(1).to_pylist())):
                ids = f"{ids} {eos}" if n else str(eos)
                row = [n + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append((*row, ids, decoded) if keep_text else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            cols = list(zip(*rows)) if rows else [[] for _ in names[: 5 if keep_text else 3]]
            kinds = [pa.int64(), *[pa.string()] * 4]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [doc_id, *names[: len(arrays)]])

    return docs.select(doc_id, text).mapInArrow(run, schema)
