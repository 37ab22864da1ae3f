"""Byte-level BPE, encoded and decoded by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import lean, table

#: White space as Unicode's property has it, and the pre-token pattern of byte_bpe_50k.json (fixed values).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{SPACE}]", c))
#: In a text without these, and with no white space at its ends, each space or newline is alone between other characters.
ODD = ("  ", " \n", "\n ", "\n\n", "\0", *sorted(SPACES - {" ", "\n"}))
#: Pieces that a Python worker keeps encoded, some 200 bytes each, so that its memory is bounded; from task to task it
#: keeps the shortest of them, half as many.
KEPT_PIECES = 500_000
#: Pre-tokens of more bytes are encoded one by one, each in a tree of its own; rows of at most this many bytes together.
WIDE, TOGETHER = 64, 1_000_000
NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A vocabulary file's merges, and encoding and decoding by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.single = np.zeros(256, dtype=np.int64)
        for letter, b in to_byte.items():
            self.single[b] = vocab[letter]
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        left, right = (np.array([vocab[m[side]] for m in merges], dtype=np.int64) for side in (0, 1))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.pair = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self.of_made = self.made.tolist()
        self.limit = KEPT_PIECES
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it cannot merge (a negative side too)."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def encode_wide(self, data: bytes) -> list[int]:
        """One long pre-token: a tree whose leaf i has the rank of the pair that begins at i, whose root has the least
        (rank, i); a merge changes three leaves and their paths. n bytes take n log n steps."""
        symbols, n = self.single[np.frombuffer(data, np.uint8)].tolist(), len(data)
        width = 1 << max(0, (n - 1).bit_length())
        none, shift = 1 << 60, width.bit_length()
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.pair.get
        tree = [none] * (2 * width)

        def leaf(i: int) -> int:
            j = after[i]
            r = get(symbols[i] << 20 | symbols[j]) if j >= 0 else None
            return none if r is None else r << shift | i

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) != none:
            i = root & ((1 << shift) - 1)
            j = after[i]
            symbols[i] = self.of_made[root >> shift]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
            symbols[j] = -1
        return [s for s in symbols if s >= 0]

    def encode_level(self, words: list[bytes], width: int) -> list[bytes]:
        """Many pre-tokens of 2 to `width` bytes (a power of two): the same trees, one a row, stepped together."""
        lengths = np.array([len(w) for w in words])
        n = len(words)
        symbols = np.full((n, width + 1), -1, dtype=np.int64)
        inside = np.arange(width) < lengths[:, None]
        symbols[:, :width][inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(width + 1)
        after = np.where(place + 1 < lengths[:, None], place + 1, width)  # `width` is a spare cell that stays empty
        before = np.broadcast_to(place - 1, (n, width + 1)).copy()
        before[:, 0] = width
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        ranks = self.rank(symbols[:, :width], symbols[:, 1:])
        tree[:, width:] = np.where(ranks < NONE, ranks * width + place[:width], NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            k = width + at
            tree[rows, k] = values
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            symbols[rows, i] = self.made[root // width]
            symbols[rows, j] = -1
            after[rows, i] = nxt = after[rows, j]
            before[rows, nxt] = i  # in the spare cell it is never read
            put(rows, j, np.full(len(rows), NONE))
            r = self.rank(symbols[rows, i], np.where(nxt < width, symbols[rows, nxt], -1))
            put(rows, i, np.where(r < NONE, r * width + i, NONE))
            p = before[rows, i]
            some = p < width
            if some.any():
                held, q = rows[some], p[some]
                r = self.rank(symbols[held, q], symbols[held, i[some]])
                put(held, q, np.where(r < NONE, r * width + q, NONE))
            rows = rows[tree[rows, 1] < NONE]
        left = symbols[:, :width]
        flat, ends = left[left >= 0].astype("<u4").tobytes(), (4 * np.cumsum((left >= 0).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: list[str]) -> None:
        """Encodes pre-tokens that are not kept yet."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            if len(b) > WIDE:
                self.words[w] = np.array(self.encode_wide(b), dtype="<u4").tobytes()
            elif len(b) == 1:
                self.words[w] = self.single[b[0]].astype("<u4").tobytes()
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((w, b))
        for width, some in by_width.items():
            step = max(1, TOGETHER // (width * 40))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                self.words.update(zip([w for w, _ in part], self.encode_level([b for _, b in part], width), strict=True))

    def cut(self, text: str) -> list[str]:
        """Pieces that pre-tokenise apart, of any text without special tokens: a piece begins at a lone space between
        characters that are no white space."""
        out: list[str] = []
        run: list[str] = []  # parts that hang together by other white space
        for part in text.split(" "):
            if run and part and part[0] not in SPACES and run[-1] and run[-1][-1] not in SPACES:
                out.append(" ".join(run))
                run = ["", part]
            else:
                run.append(part)
        return [p for p in [*out, " ".join(run)] if p]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plan: list[list] = []
        need: set[str] = set()
        kept = self.pieces
        for text in texts:
            if "<|" in text and self.special_pattern.search(text):
                steps, at = [], 0
                for m in self.special_pattern.finditer(text):
                    steps += [*self._pieces(text[at : m.start()]), m[0]]
                    at = m.end()
                    kept[m[0]] = self.special[m[0]].to_bytes(4, "little")
                steps += self._pieces(text[at:])
            else:
                steps = self._pieces(text)
            plan.append(steps)
            need.update(steps)
        todo = list(need.difference(kept))
        for k in range(0, len(todo), 50_000):
            self._prepare_part(todo[k : k + 50_000])
        out = [b"".join(map(kept.__getitem__, steps)) for steps in plan]
        if len(kept) > self.limit or len(self.words) > self.limit:
            self.trim()
        return out

    def trim(self) -> None:
        """Forgets encoded pieces but for short ones, which are likely to come again."""
        self.pieces, self.words = shortest(self.pieces, self.limit // 2), shortest(self.words, self.limit // 2)

    def _prepare_part(self, pieces: list[str]) -> None:
        cut = [PATTERN.findall(p) for p in pieces]
        self.encode_words(list({w for c in cut for w in c}.difference(self.words)))
        for p, c in zip(pieces, cut, strict=True):
            self.pieces[p] = b"".join(map(self.words.__getitem__, c))

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if not any(x in text for x in ODD) and text[0] not in " \n" and text[-1] not in " \n":
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return self.cut(text)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that are no UTF-8 become U+FFFD, as a text must be."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", errors="replace").encode()


def shortest(store: dict, most: int, length: int = 12) -> dict:
    """The entries of a store whose keys are shorter than that, or yet shorter if they are more than so many."""
    if len(store) <= most:
        return store
    kept = {k: v for k, v in store.items() if len(k) < length}
    return kept if len(kept) <= most or length < 3 else shortest(kept, most, length - 1)


@cache
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", kept: int = KEPT_PIECES) -> DataFrame:
    """df with `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string) added, columns so named replaced.

    Encodes whole texts: special tokens' strings become their ids, the rest is pre-tokenised and each pre-token merged
    by a segment tree. Equal to the tokenizers library on the same file. Null and empty texts have no ids and decode to
    the empty text; repeated rows each have theirs; an empty table gives no rows. Rows are independent of each other: no shuffle; a worker holds one Arrow batch's part of at most
    TOGETHER characters (or one text) at a time, and keeps `kept` encoded pieces: fewer take less memory and more time.
    vocabulary is a path that every executor has.
    """
    rest = [c for c in df.columns if c not in ("ids", "decoded")]
    schema = df.select(*rest).schema.add("ids", "binary").add("decoded", "string")
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(vocabulary)
        model.limit = kept
        for batch in batches:
            for part in parts(batch, at, TOGETHER):
                ids = model.encode_texts([t or "" for t in part.column(at).to_pylist()])
                decoded = pa.array([model.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), decoded], [*rest, "ids", "decoded"])
        model.trim()

    return df.select(*rest).mapInArrow(lean(run), schema)


def parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (or binaries) have `limit` bytes at most, or one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def op7_bpe(spark, sf_dir):
    """Every document's ids and their decoded text; see encode_decode for nulls, repeats and empty tables."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
