"""Token counts that follow edits.

A text's pre-tokens are grouped into leaves, cut where a letter or digit meets
a blank, a line feed or a mark: there a pre-token ends whatever stands around
the two characters, so leaves can be counted on their own. A segment tree over
the leaves holds sums of characters and tokens. An edit is found by descending
the character sums; only the leaves that it touches, and the next one where it
touches a leaf's edge, are encoded again, cut into leaves anew, and the sums
above them change; where they became more leaves, the tree is balanced again
over the kept counts. Trees are results: a later edit takes the tree that an
earlier one left. One pre-token is never cut, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 256  #: a leaf ends at the first safe place from here
#: Marks that begin a pre-token after a letter or digit, in patterns that never
#: add a mark to the letters before it; the apostrophe may begin a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~，。、；：？！「」『』（）《》【】…—“”·"
_SAFE = re.compile(rf"(?<=[^\W_])[ \n{re.escape(_MARKS)}]")
#: What `redactions` replaces: mail addresses, and digit runs as in phone or card numbers.
PERSONAL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d ()-]{7,}\d")
EDITS = "array<struct<at: int, cut: int, put: string>>"
_encoders: dict[str, Callable[[str], int]] = {}  # by vocabulary file, for a worker's tasks


def counter(vocabulary: str, pattern: str) -> Callable[[str], int]:
    key = f"{vocabulary}\0{pattern}"
    if key not in _encoders:
        import tiktoken

        from cairn.llm.bpe import read_ranks

        encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(vocabulary), special_tokens={}).encode_ordinary
        _encoders[key] = lambda text: len(encode(text))
    return _encoders[key]


def leaves(text: str) -> list[int]:
    """Lengths of a text's leaves."""
    out, at = [], 0
    while at < len(text):
        m = _SAFE.search(text, at + LEAF_CHARS)
        end = m.start() if m else len(text)
        out.append(end - at)
        at = end
    return out


def counted(text: str, count: Callable[[str], int]) -> tuple[list[int], list[int]]:
    """Characters and tokens of a text's leaves."""
    sizes, held, at = leaves(text), [], 0
    for n in sizes:
        held.append(count(text[at : at + n]))
        at += n
    return sizes, held


class Tree:
    """Sums over a text's leaves: node 1 is the root, 2i and 2i + 1 below i."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> Tree:
        return cls.over(*counted(text, count))

    @classmethod
    def over(cls, sizes: list[int], held: list[int]) -> Tree:
        """Balanced over leaves of so many characters and tokens."""
        width = 1 << max(0, len(sizes) - 1).bit_length()
        chars, tokens = np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64)
        for sums, own in ((chars, sizes), (tokens, held)):
            sums[width : width + len(own)] = own
            at = width
            while at > 1:
                sums[at // 2 : at] = sums[at : 2 * at : 2] + sums[at + 1 : 2 * at : 2]
                at //= 2
        return cls(chars, tokens)

    def leaf(self, at: int) -> tuple[int, int]:
        """(number, start) of the leaf with character `at`; past the end, the last that has any."""
        at = min(at, int(self.chars[1]) - 1)
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i]:
                start += int(self.chars[i])
                i += 1
        return i - self.width, start

    def put(self, regions: list[tuple[int, int, list[int], list[int]]]) -> None:
        """For each region, in order: its first and last leaf become leaves of
        so many characters and tokens. Sums change along their paths, or the
        tree is balanced again where a region has more leaves than before."""
        if all(len(sizes) <= last - first + 1 for first, last, sizes, _ in regions):
            for first, last, sizes, held in regions:
                for k, i in enumerate(range(first, last + 1)):
                    self._set(i + self.width, *((sizes[k], held[k]) if k < len(sizes) else (0, 0)))
            return
        parts: list[tuple] = []
        done, leaves_ = 0, slice(self.width, 2 * self.width)
        for first, last, sizes, held in [*regions, (self.width, self.width, [], [])]:
            parts += [(self.chars[leaves_][done:first], self.tokens[leaves_][done:first]), (sizes, held)]
            done = last + 1
        sizes, held = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in (0, 1))
        new = Tree.over(sizes[sizes > 0].tolist(), held[sizes > 0].tolist())
        self.chars, self.tokens, self.width = new.chars, new.tokens, new.width

    def _set(self, i: int, chars: int, tokens: int) -> None:
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], count: Callable[[str], int]) -> tuple[str, int]:
    """Apply edits (position, characters removed, text put in), given in the
    text's own positions, without overlap; updates the tree. Returns the new
    text and the number of characters that were encoded again."""
    out, again = [], 0
    regions: list[list] = []  # first leaf, last leaf, start, end, edits
    size = len(text)
    for at, cut, put in sorted(edits, key=lambda e: e[0]):
        if not size:
            regions = regions or [[0, 0, 0, 0, []]]
            regions[0][4].append((at, cut, put))
            continue
        first, start = tree.leaf(at)
        last, s = tree.leaf(max(at, at + cut - 1))
        end = s + int(tree.chars[tree.width + last])
        if at <= start > 0:  # the leaf's first character changes: take the one before
            first, start = tree.leaf(start - 1)
        if at + cut >= end < size:
            last, s = tree.leaf(end)
            end = s + int(tree.chars[tree.width + last])
        if regions and first <= regions[-1][1]:
            regions[-1][1], regions[-1][3] = max(last, regions[-1][1]), max(end, regions[-1][3])
            regions[-1][4].append((at, cut, put))
        else:
            regions.append([first, last, start, end, [(at, cut, put)]])
    done, changed = 0, []
    for first, last, start, end, own in regions:
        part, at = [], start
        for p, cut, put in own:
            part += [text[at:p], put]
            at = p + cut
        part.append(text[at:end])
        new = "".join(part)
        changed.append((first, last, *counted(new, count)))
        again += len(new)
        out += [text[done:start], new]
        done = end
    out.append(text[done:])
    tree.put(changed)
    return "".join(out), again


def redactions(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end() - m.start(), "[removed]") for m in PERSONAL.finditer(text)]


def find_redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`' id and text with `edits` that replace personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("cut", pa.int32()), ("put", pa.string())]))
        for b in batches:
            found = [[{"at": a, "cut": c, "put": p} for a, c, p in redactions(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], ["_id", "_text", "edits"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _text string, edits {EDITS}")
    return out.withColumnsRenamed({"_id": id_col, "_text": text_col})


def in_order(edits: list[dict | None] | None, size: int) -> list[tuple[int, int, str]]:
    """Edits by position, inside the text: what lies outside is moved to its
    nearest end, negative cuts are none, and of a place that two edits cut the
    first has it: the later starts where the earlier ends."""
    out, end = [], 0
    for e in sorted((e for e in edits or [] if e), key=lambda e: e["at"] or 0):
        at = min(max(0, e["at"] or 0), size)
        stop = min(at + max(0, e["cut"] or 0), size)
        at = max(at, end)
        end = max(at, stop)
        out.append((at, end - at, e["put"] or ""))
    return out


def count_edited(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tree_cols: tuple[str, str] | None = None, with_text: bool = False
) -> DataFrame:
    """One row per row of `docs`: id, `n_tokens` before and `n_tokens_edited`
    after the `edits` (array of at, cut, put; positions in code points of the
    text), `n_chars_edited`, `chars_encoded_again`, the tree after it
    (`tree_chars`, `tree_tokens`: sums, root at 1), and, `with_text`, the
    `text_edited`.

    `tree_cols` names the columns of a tree that an earlier call returned for
    this text: then only what the edits touch is encoded at all. A null tree is
    built from the text; one whose characters are not the text's raises.

    Null texts count as empty and have 0 tokens; null edits are none;
    `in_order` says what overlapping, negative and far edits do. Rows are
    independent: repeated rows and null ids stay as they are, other columns are
    not read, an empty table gives no rows. One narrow pass; memory holds one
    Arrow batch and one tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, pattern)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text, edits, chars, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                text = text or ""
                if chars.is_valid and tokens.is_valid:
                    tree = Tree(*(np.array(x.values.to_numpy()) for x in (chars, tokens)))
                    if tree.chars[1] != len(text):
                        raise ValueError("a kept tree belongs to another text")
                else:
                    tree = Tree.of(text, count)
                before = int(tree.tokens[1])
                asked = in_order(edits, len(text))
                new, again = edit(text, tree, asked, count) if asked else (text, 0)
                for c, v in zip(cols, (before, int(tree.tokens[1]), len(new), again, tree.chars, tree.tokens, new if with_text else None), strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[4:6]] + [pa.array(cols[6], pa.string())]
            names = ["_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "chars_encoded_again", "tree_chars", "tree_tokens", "text_edited"]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names)

    kept = [F.col(c).cast("array<long>") for c in tree_cols] if tree_cols else [F.lit(None).cast("array<long>")] * 2
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(edits_col).cast(EDITS).alias("_edits"), kept[0].alias("_c"), kept[1].alias("_t"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, n_tokens_edited long, n_chars_edited long, chars_encoded_again long, tree_chars array<long>, tree_tokens array<long>, text_edited string"
    out = rows.mapInArrow(run, schema)
    return (out if with_text else out.drop("text_edited")).withColumnsRenamed({"_id": id_col})
