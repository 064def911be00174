"""Order-preserving packing of token sequences by dynamic programming."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A mark between a Latin letter and white space. Other letters may leave a combining sign when they are composed or
#: lower-cased (U+0130, U+0958), which the tokenizer joins with the mark; those stay with it in one chunk.
_MARK = re.compile("([.,!?;:])(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f].)(?=\\s|$)")
#: Beyond Latin letters, whose case and composition are the same to Python and to the tokenizer.
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")


class WordTokenizer:
    """Ids of whole texts, through a table of white-space separated chunks.

    The tokenizer lower-cases, drops white space and never joins across it or between a
    letter and a mark, so a text's ids are those of its chunks, and a mark after a Latin
    letter is a chunk of its own. The table is a cache of two generations of ``most`` chunks: what
    is still used when the younger is full moves on, the rest is forgotten.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._of, self._most = Tokenizer.from_file(path), most
        self._model = self._of.model
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)  # how the vocabulary writes bytes
        self._bytes = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180) if chr(c).isalpha()}
        self._ids: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._ends = [np.uint32(self._of.encode(mark, add_special_tokens=False).ids[-1]) for mark in ".!?"]

    def _learn(self, words: list[str]) -> None:
        known, older = self._ids, self._older
        if older:
            for w in older.keys() & words:
                known[w] = older[w]
        new = [w for w in words if w not in known]
        rest = []
        for w in new:
            # a run of small Latin letters passes the tokenizer's normaliser and splitter unchanged
            if w.isalpha() and w.islower() and (w.isascii() or not _BEYOND.search(w)):
                known[w] = array("I", [t.id for t in self._model.tokenize(w.translate(self._bytes))]).tobytes()
            else:
                rest.append(w)
        for w, e in zip(rest, self._of.encode_batch(rest, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, positions after which a sentence ends)."""
        if text.isascii() or not _BEYOND.search(text):
            text = text.lower()
        text = _MARK.sub(r" \1", text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, signs to the tokenizer
            words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        else:
            words = text.split()
        if len(self._ids) > self._most:
            self._older, self._ids = self._ids, {}
        known = self._ids
        parts = list(map(known.get, words))
        if None in parts:
            holes = [i for i, p in enumerate(parts) if p is None]
            self._learn(list(dict.fromkeys(words[i] for i in holes)))
            for i in holes:
                parts[i] = known[words[i]]
        ids = np.frombuffer(b"".join(parts), "<u4")
        end = ids == self._ends[0]
        for e in self._ends[1:]:
            end |= ids == e
        return ids, np.flatnonzero(end) + 1


def plan_cuts(doc_ends: np.ndarray, soft: np.ndarray, width: int, soft_cost: int = 16, hard_cost: int = 48, grid: int = 64) -> list[int]:
    """Positions at which a stream of doc_ends[-1] tokens is cut into windows of at most ``width``.

    A window of n tokens costs its padding, width - n, or nothing if n is a power of two;
    a cut costs nothing at the end of a document, ``soft_cost`` at the end of a sentence
    (soft) and ``hard_cost`` elsewhere, where one may stand at each multiple of ``grid``
    within a document. Minimises the sum: best[j] = cost of cut j + width - j + the least
    best[i] + i over the last ``width`` tokens, whose candidates stand in a monotone
    queue; the powers of two are looked up one by one. No documents give no cuts; empty
    documents (repeated ends) are no windows. Of equal sums the longest window stands.
    """
    total = int(doc_ends[-1]) if len(doc_ends) else 0
    if not total:
        return []
    cost = np.full(total + 1, -1, np.int32)
    cost[0 : total + 1 : grid] = hard_cost
    cost[soft] = soft_cost
    cost[doc_ends] = 0
    cost[total] = 0
    cost[0] = 0
    points = np.flatnonzero(cost >= 0)
    at, price = points.tolist(), cost[points].tolist()
    index = np.full(total + 1, -1, np.int32)
    index[points] = np.arange(len(points))
    powers = [1 << k for k in range(width.bit_length()) if 1 << k <= width]
    back = {p: index[np.maximum(points - p, 0)] * (points >= p) - (points < p) for p in powers}
    table = np.stack([back[p] for p in powers], axis=1)
    first = np.concatenate([[0], np.cumsum((table >= 0).sum(axis=1))]).tolist()
    steps = table[table >= 0].tolist()  # those of point j at first[j] : first[j + 1]
    best, prev = [0] * len(at), [0] * len(at)
    lead, queue, head = [0] * len(at), [0], 0  # best[i] + i; the monotone queue
    far = np.searchsorted(points, points - width).tolist()  # the first point that a window ending at j may start at
    j, last = 0, first[1]
    for x, cost_here, nearest, stop in zip(at[1:], price[1:], far[1:], first[2:], strict=True):
        j += 1
        while queue[head] < nearest:
            head += 1
        i = queue[head]
        least = lead[i] + width - x
        if last != stop:
            for k in steps[last:stop]:
                if best[k] < least:
                    least, i = best[k], k
            last = stop
        least += cost_here
        best[j], prev[j] = least, i
        lead[j] = here = least + x
        while len(queue) > head and lead[queue[-1]] >= here:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = prev[j]
    return cuts[::-1]


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4096,
    end_id: int = 2,
    shard_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Documents are packed where they are scanned, in their order, in shards that are closed
    by the document that brings them to ``shard_tokens`` tokens, so nothing is shuffled and
    a task holds one shard. Shards start anew at each partition of docs: sequence ids and
    cuts are those of the partitions that a scan is split into, and the same on a rerun
    with that split. A sequence is padded to ``width`` unless its length is a power of two. Null and empty texts are the end id alone; a row repeated is
    packed twice; a null id stays null. ``tokenizer`` is the vocabulary's file, or None
    for the installed word_bpe_49k.json.
    """

    def pack(batches):
        from pyspark import TaskContext

        words, part, shard = _tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for doc, text in zip(ids.to_pylist(), texts, strict=True):
                got, soft = words.encode(text.as_py() or "")
                held.append((doc, np.append(got, np.uint32(end_id)), soft))
                tokens += len(got) + 1
                if tokens >= shard_tokens:
                    yield from _pieces(held, width, (part << 40) + (shard << 20))
                    held, tokens, shard = [], 0, shard + 1 + (tokens >> 20)
        if held:
            yield from _pieces(held, width, (part << 40) + (shard << 20))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA + ", ids binary")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str | None) -> WordTokenizer:
    """One table per worker process, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _pieces(held: list[tuple], width: int, first_sequence: int):
    ends = np.cumsum([len(ids) for _, ids, _ in held])
    begins = ends - [len(ids) for _, ids, _ in held]
    soft = np.concatenate([b + s for b, (_, _, s) in zip(begins, held, strict=True)]).astype(np.int64)
    cuts = np.array(plan_cuts(ends, soft, width), np.int64)
    stream = np.concatenate([ids for _, ids, _ in held])
    starts = np.unique(np.concatenate([begins, [0], cuts[:-1]]))
    stops = np.append(starts[1:], ends[-1])
    doc = np.searchsorted(ends, starts, "right")
    seq = np.searchsorted(cuts, starts, "right")
    from_ = np.concatenate([[0], cuts[:-1]])[seq]
    for a in range(0, len(starts), 4096):
        s, e, d, q = starts[a : a + 4096], stops[a : a + 4096], doc[a : a + 4096], seq[a : a + 4096]
        raw = [stream[x:y].astype("<u4").tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][0] for i in d.tolist()], pa.int64()), pa.array(s - begins[d]), pa.array(e - s), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array((ends - begins)[d]), pa.array(first_sequence + q), pa.array(s - from_[a : a + 4096]), pa.array(raw, pa.binary()),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )
