"""Byte-level BPE: encoding and decoding by DuckDB queries in each partition.

A partition's texts are cut into words by the tokenizer's pattern. Words not
met before go to an embedded SQL engine as rows (word, position, token); a
recursive query joins neighbours to the merge table and contracts the leftmost
pair of minimum rank in each word until none is left. Decoding joins ids to
their bytes and aggregates those in order.

Why long words may contract many places at a time:

* The merge table has one rule for a token: the last step of the token's own
  bytes, encoded alone. Where a token comes to be in any word, the steps inside
  its bytes were those that it takes alone, so no other rule for it ever fires.
* In a vocabulary that rises (checked), each rule's result has a higher rank
  than its parts. So contracting a pair of rank r makes pairs above r only.
* A pair of rank r that is least within a stretch of the word on both sides, the
  stretch no shorter than the longest token, can't be touched before its turn:
  that would take a token of rank r or less that reaches from it to a pair
  outside, and so is longer than any. Equal pairs there come in order, which
  for overlapping ones (a run of one token) is every other one from the run's
  first.

Stretches are aligned blocks of positions and the two beside them. A plainer
query, one contraction of a word at a time, takes words of at most `SHORT` bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import remembered

KNOWN_WORDS = 500_000  #: that a worker remembers; beyond it the less met half goes
CHUNK_CHARS = 2_000_000  #: of texts cut into words at a time
SHORT = 64  #: bytes of a word for the plainer query
BATCH_BYTES = 400_000  #: of words in a query, but for a longer word
BATCH_TOKENS = 1_000_000  #: decoded in a query
MEMORY_MB = 200  #: of a query; more for a word longer than a batch

# npos and nx are the next token's position and id; a token of -1 is part of the one before.
# k packs a pair's rank, position and next position; the products, as the engine's shifts and masks share a precedence.
_SHORT = """
WITH RECURSIVE s(w, pos, npos, tok, nx) USING KEY (w, pos) AS (
  SELECT w, pos, npos, tok, nx FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (SELECT s.*, m.t::BIGINT * 16384 + pos * 128 + npos AS k FROM s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nx WHERE tok >= 0),
        b AS (SELECT w, min(k) AS k FROM p GROUP BY w HAVING min(k) IS NOT NULL),
        q AS (SELECT b.w, (b.k // 16384)::INT AS bt, ((b.k // 128) % 128)::INT AS bpos, (b.k % 128)::INT AS bnext, p.nx AS after, p.npos AS after_pos
              FROM b JOIN p ON p.w = b.w AND p.pos = (b.k % 128)::INT)
   SELECT p.w, p.pos, CASE WHEN p.pos = bpos THEN after_pos ELSE p.npos END, CASE WHEN p.pos = bpos THEN bt WHEN p.pos = bnext THEN -1 ELSE p.tok END,
          CASE WHEN p.pos = bpos THEN after WHEN p.npos = bpos THEN bt ELSE p.nx END
   FROM p JOIN q ON p.w = q.w)
) SELECT w, tok FROM s WHERE tok >= 0 ORDER BY w, pos"""

# Positions run over all words, each from a block's start with an empty block before the next.
_LONG = """
WITH RECURSIVE s(w, pos, npos, tok, nx) USING KEY (pos) AS (
  SELECT w, pos, npos, tok, nx FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (SELECT s.*, m.t FROM s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nx WHERE tok >= 0),
        b AS (SELECT pos // {block} AS blk, any_value(w) AS w, min(t) AS best FROM p GROUP BY ALL),
        near AS MATERIALIZED (SELECT blk, min(best) OVER (ORDER BY blk RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS best, min(best) OVER (PARTITION BY w) AS live FROM b),
        hits AS MATERIALIZED (SELECT pos, npos, t, tok, tok = nx AS twin FROM p JOIN near ON near.blk = pos // {block} WHERE t = best),
        twins AS (SELECT pos, tok, npos - pos AS size, row_number() OVER (PARTITION BY tok ORDER BY pos) AS i FROM p WHERE tok = nx AND t IS NOT NULL),
        runs AS (SELECT pos, pos - first_value(pos) OVER o AS past, size, first_value(pos) OVER o AS head FROM twins WINDOW o AS (PARTITION BY tok, pos - i * size ORDER BY pos)),
        starts AS MATERIALIZED (
          SELECT pos, npos AS q, t FROM hits WHERE NOT twin
          UNION ALL SELECT hits.pos, npos, t FROM hits JOIN runs USING (pos) WHERE past // size % 2 = 0 AND head IN (SELECT pos FROM hits)),
        e AS (SELECT starts.*, p.npos AS after_pos, coalesce(n.t, p.nx) AS after FROM starts JOIN p ON p.pos = starts.q LEFT JOIN starts n ON n.pos = p.npos)
   SELECT p.w, p.pos, CASE WHEN e.pos IS NULL THEN p.npos ELSE e.after_pos END, CASE WHEN g.q IS NOT NULL THEN -1 ELSE coalesce(e.t, p.tok) END,
          CASE WHEN e.pos IS NULL THEN coalesce(n.t, p.nx) ELSE e.after END
   FROM p JOIN near ON near.blk = p.pos // {block} LEFT JOIN e ON e.pos = p.pos LEFT JOIN starts n ON n.pos = p.npos LEFT JOIN starts g ON g.q = p.pos
   WHERE live IS NOT NULL)
) SELECT w, tok FROM s WHERE tok >= 0 ORDER BY pos"""

_DECODE = "SELECT d, list(v.bytes ORDER BY i) AS parts FROM ids JOIN vocab v ON v.id = tok GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_rules(ranks: dict[bytes, int]) -> pa.Table:
    """`l, r, t`: the one rule of each token that its own bytes encode to. A
    vocabulary that does not rise is refused."""
    rules = []
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            i, least = -1, len(ranks)
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1], least)
                if r < least:
                    i, least = k, r
            if i < 0:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            l, r = ranks[parts[0]], ranks[parts[1]]
            if (len(parts[0]) > 1 and l > rank) or (len(parts[1]) > 1 and r > rank):
                raise ValueError(f"token {rank} has a part of a higher rank")
            rules.append((l, r, rank))
    return pa.table({n: pa.array(x, pa.int32()) for n, x in zip("lrt", zip(*rules) if rules else ([], [], []))})


class Coder:
    """Words to ids and ids to bytes, in an engine of its own: one thread,
    bounded memory, nothing on disk."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self.block = max(map(len, ranks))
        self._table("merges", merge_rules(ranks))
        self._table("vocab", pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.sql.register("incoming", rows)
        self.sql.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.sql.unregister("incoming")

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all ids, word after word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts, ids = np.zeros(len(words), np.int64), {}
        for query, own in ((_SHORT, np.flatnonzero((size <= SHORT) & (size > 0))), (_LONG, np.flatnonzero(size > SHORT))):
            for at in np.split(own, np.flatnonzero(np.diff(np.cumsum(size[own]) // BATCH_BYTES)) + 1) if len(own) else []:
                counts[at], part = self._encode([words[i] for i in at], query)
                ids.update(zip(at.tolist(), np.split(part, np.cumsum(counts[at])[:-1]), strict=True))
        return counts, np.concatenate([ids[i] for i in sorted(ids)]) if ids else np.empty(0, np.int32)

    def _encode(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.zeros(len(words), np.int64)
        if query is _LONG:
            room = -(-sizes // self.block) + 1
            first = (np.cumsum(room) - room) * self.block
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        pos = np.arange(len(tok)) + np.repeat(first - (ends - sizes), sizes)
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        rows = {"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": tok}
        rows |= {"npos": pa.array((pos + 1).astype(np.int32), mask=last), "nx": pa.array(np.append(tok[1:], np.int32(0)), mask=last)}
        self._table("start", pa.table(rows))
        long = len(tok) > BATCH_BYTES + SHORT
        if long:
            self.sql.execute(f"SET memory_limit = '{MEMORY_MB + len(tok) // 2000}MB'")
        found = self.sql.sql(query.format(block=self.block)).to_arrow_table()
        w, out = (found.column(k).to_numpy() for k in range(2))
        self.sql.execute("DROP TABLE start")
        if long:
            self.sql.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        return np.bincount(w, minlength=len(words)), out

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each run of `counts` ids."""
        out: list[bytes] = [b""] * len(counts)
        run = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        for at in range(0, len(ids), BATCH_TOKENS):
            tok = ids[at : at + BATCH_TOKENS]
            rows = {"d": run[at : at + BATCH_TOKENS], "i": np.arange(len(tok), dtype=np.int32), "tok": tok}
            self._table("ids", pa.table(rows))
            for b in self.sql.sql(_DECODE).to_arrow_table().to_batches():
                parts = b.column(1)
                edge = np.frombuffer(parts.values.buffers()[1], np.int32)[parts.values.offset :]
                text, cut = memoryview(parts.values.buffers()[2]), edge[parts.offsets.to_numpy()].tolist()
                for k, d in enumerate(b.column(0).to_pylist()):
                    out[d] += text[cut[k] : cut[k + 1]]
        return out


class Words(dict):
    """word -> its number; `start` and `count` of its ids in `ids`."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder, self.new = coder, []
        self._hold(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))

    def _hold(self, count: np.ndarray, ids: np.ndarray, met: np.ndarray) -> None:
        self.count, self.ids, self.met, self.start = count, ids, met, np.cumsum(count) - count

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def ids_of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, given in words, and all their ids."""
        self._forget()
        numbers = np.concatenate([np.empty(0, np.int64), *(np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts)])
        if self.new:
            count, ids = self.coder.encode([w.encode() for w in self.new])
            self._hold(np.concatenate([self.count, count]), np.concatenate([self.ids, ids]), np.concatenate([self.met, np.zeros(len(count), np.int64)]))
            self.new.clear()
        self.met += np.bincount(numbers, minlength=len(self))
        ends, n = np.cumsum(self.count[numbers]), self.count[numbers]
        ids = self.ids[np.repeat(self.start[numbers] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, texts)])]
        return np.diff(bounds), ids

    def _forget(self) -> None:
        if len(self) <= KNOWN_WORDS:
            return
        keep = self.met > np.partition(self.met, -KNOWN_WORDS // 2)[-KNOWN_WORDS // 2]
        words = [w for w, k in zip(self, keep.tolist(), strict=True) if k]
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self._hold(self.count[keep], self.ids[np.repeat(keep, self.count)], self.met[keep])


def words_of(path: str) -> Words:
    """What a worker's tasks have learnt of a vocabulary file."""
    return remembered(path, lambda: Words(Coder(read_ranks(path))))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `ids` (array of int, no special tokens)
    and `decoded`: the bytes that these ids stand for.

    `vocabulary` is a file of base64 token and rank per line with all single
    bytes, on every executor; `pattern` cuts texts into words. Null texts count
    as empty and have no ids. Rows are independent: repeated rows and null ids
    stay as they are, other columns are not read, an empty table gives no rows.
    One narrow pass: no shuffle. Memory holds a chunk's words and a bounded
    number of known ones; a step of the query takes one pair of each word, of a
    word longer than `SHORT` bytes at least one in every few stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = words_of(vocabulary), regex.compile(pattern)
        for batch in batches:
            at = 0
            for texts in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                counts, ids = known.ids_of([cut.findall(t) for t in texts])
                decoded = known.coder.decode(counts, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), _lists(counts, ids), pa.array(decoded, pa.binary())], ["_id", "ids", "decoded"])
                at += len(texts)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary").withColumnsRenamed({"_id": id_col})


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of `encoded`: id and `decoded`, the bytes of its ids.
    Null and empty arrays have none; null ids, and ids that the vocabulary has
    not, stand for no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words_of(vocabulary).coder
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            ids = np.array([-1 if i is None else i for x in lists for i in x], np.int32)
            decoded = coder.decode(np.array([len(x) for x in lists], np.int64), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["_id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, f"_id {encoded.schema[id_col].dataType.simpleString()}, decoded binary").withColumnsRenamed({"_id": id_col})


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, `n_tokens`, and the SHA-256 of the decimal ids and of the decoded bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
