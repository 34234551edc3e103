"""Byte-level BPE encoding and decoding by tree concatenation.

Ids equal those of `tokenizers` with the same file and its default settings: added tokens found in a text keep their own
ids, and texts are parted by its pre-tokenizer. A part that this doesn't split and that is longer than `leaf` bytes is cut
into halves, and these again; leaves are encoded apart, and two neighbours are joined by encoding a window of tokens around
the join anew. The window grows on each side until its outermost token there is the one that the neighbour had (or the
neighbour is used up). That is exact: tokens are the encoding of their bytes if, and only if, each two adjacent ones are
the encoding of theirs, as merges stand in the file after those that make their parts (a file for which that does not hold
is refused); all adjacent pairs stem from one of the two sides or from the window.

Texts without an unsplit part over `spread` characters are encoded where they are, in a narrow map. For the others every
distinct text is parted once; its ordinary parts and leaves are rows of their own, encoded in parallel over the cluster,
and leaves are joined in rounds of neighbours, so one very long part keeps many tasks busy. Their rows move by digest.

Null texts are empty and give no ids; repeated rows give a row each; other columns are not read. A text's ids are one
value, so a text may have half a billion tokens (Spark's limit of 2 GB for a value). Ids beyond the vocabulary are
refused by decode(), and null ids decode to the empty text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.llm.common import Scratch

FILE = "byte_bpe_50k.json"
LEAF, SPREAD, WINDOW = 2048, 1 << 20, 8
#: Chunks kept with their ids in each Python worker.
CACHE = 300_000
_CUT = re.compile(r"(?<=\S)(?=\x20\S)")
_UNSAFE = re.compile(r"\s\x20|\x20\s")
#: Characters of one kind in a row, which the pre-tokenizer doesn't split; a run is looked at from its start only.
_KINDS = (r"\p{L}", r"\p{N}", r"[^\p{IsWhite_Space}\p{L}\p{N}]", r"\p{IsWhite_Space}")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes in their order are the characters from U+0100 on."""
    plain = {b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Text to ids and back, by the file of a byte-level BPE."""

    def __init__(self, path: str, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before, added = file["model"], file["pre_tokenizer"], file["added_tokens"]
        if file["normalizer"] or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        byte = _bytes_of_symbols()
        marks = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in marks}
        known = sorted(ranks[bytes([b])] for b in range(256))
        for k, merge in enumerate(model["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            known.append(ranks[a + b])
            if ranks[a + b] != 256 + k or max(ranks[a], ranks[b]) >= 256 + k:
                raise ValueError(f"{path}: merges do not stand in the order of ids")
        if known != list(range(len(ranks))):
            raise ValueError(f"{path}: tokens without a merge of their own")
        self.leaf = leaf
        self.words = [*ranks, *[b""] * (max([*marks.values(), len(ranks) - 1]) + 1 - len(ranks))]
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in marks.items())]:
            self.words[i] = token
        self.marks = {m: np.array([i], "<u4").tobytes() for m, i in marks.items()}
        self.mark = re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)) or r"(?!)")
        #: The rule of byte-level pre-tokenizers, a fixed value.
        rule = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.rule = regex.compile(rule.replace(r"^\s", r"^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        own = tiktoken.Encoding("file", pat_str=rule, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.piece = own.encode_ordinary, own._encode_single_piece
        self.chunks: dict[str, bytes] = {}

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is an added token) in order."""
        at = 0
        for m in self.mark.finditer(text):
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def chunked(self, text: str) -> list[str]:
        """Chunks that can be encoded apart: a token ends where a space stands between two characters that aren't white."""
        if _UNSAFE.search(text):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return b"".join([self.marks[part] if marked else self._plain(part) for part, marked in self.parts(text)])

    def _plain(self, text: str) -> bytes:
        known = self.chunks
        return b"".join([known.get(c) or self._chunk(c) for c in self.chunked(text)])

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) * 4 > self.leaf:
            return b"".join(np.array(self.tree(piece.encode()), "<u4").tobytes() for piece in self.rule.findall(chunk))
        ids = np.array(self.ordinary(chunk), "<u4").tobytes()
        if len(self.chunks) < CACHE and len(chunk) < 64:
            self.chunks[chunk] = ids
        return ids

    def tree(self, raw: bytes) -> list[int]:
        """Ids of an unsplit part: those of its halves, joined."""
        if len(raw) <= self.leaf:
            return self.piece(raw) if raw else []
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of both, which are the ids of two neighbours."""
        if not left or not right:
            return left or right
        i = j = WINDOW
        while True:
            a, b = left[-i:], right[:j]
            window = self.piece(b"".join([self.words[x] for x in a + b]))
            agree_left, agree_right = i >= len(left) or window[0] == a[0], j >= len(right) or window[-1] == b[-1]
            if agree_left and agree_right:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = i if agree_left else 2 * i, j if agree_right else 2 * j

    def decode(self, ids: bytes) -> str:
        """Text of the ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        words = self.words
        return b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(name: str = FILE, leaf: int = LEAF) -> Codec:
    """The codec of a public vocabulary file, once in each Python worker."""
    import public_tokenizers

    return Codec(public_tokenizers.path(name), leaf)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = FILE, leaf: int = LEAF, spread: int = SPREAD, decoded_col: str | None = None) -> DataFrame:
    """(id, n_tokens, ids) for each row; ids are little-endian unsigned 32-bit numbers in one binary value. With decoded_col
    also the text that decode() gives for them, which saves a second pass through Python workers."""
    added = [decoded_col] if decoded_col else []
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, leaf)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            texts = [pa.array([own.decode(i) for i in ids], pa.string())] if added else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *texts], ["key", "ids", *added])

    unsplit = "|".join(rf"(?<!{k}){k}{{{spread + 1},}}+" for k in _KINDS)
    far = (F.length("text") > spread) & F.col("text").rlike(unsplit)
    made = rows.filter(~far).mapInArrow(near, f"key {kind}, ids binary" + "".join(f", `{c}` string" for c in added))
    long = rows.filter(far).withColumn("digest", F.sha2("text", 256))
    if not long.isEmpty():
        ids = _spread(long, name, leaf, spread)
        coded = long.select("key", "digest").hint("merge").join(ids, "digest").select("key", "ids")
        if added:
            coded = decode(coded.withColumn("_ids", F.col("ids")), "_ids", decoded_col, name).select("key", "ids", decoded_col)
        made = made.union(coded)
    return made.select(F.col("key").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *added)


def _pieces(own: Codec, text: str, spread: int) -> Iterator[tuple[bool, bytes]]:
    """(whether it is an unsplit part of a chunk over `spread` characters, bytes) in order; other pieces are whole chunks
    or added tokens, which can be encoded together."""
    for plain, marked in own.parts(text):
        for chunk in [plain] if marked else own.chunked(plain):
            if len(chunk) > spread:
                yield from ((True, x.encode()) for x in own.rule.findall(chunk))
            elif chunk:
                yield False, chunk.encode()


def _spread(long: DataFrame, name: str, leaf: int, spread: int) -> DataFrame:
    """(digest, ids) of each distinct text, its parts encoded as rows. Part p of a text has nodes 0, 1, ...: ordinary
    chunks are one node, an unsplit part has a node for each leaf of at most spread bytes."""
    scratch = Scratch(long.sparkSession, "bpe")
    texts = scratch.write(long.groupBy("digest").agg(F.first("text").alias("text")), "texts")

    def nodes(own: Codec, text: str) -> Iterator[tuple[int, int, bool, list[bytes]]]:
        """(part, node, whether the pieces are unsplit parts, pieces)"""
        part, held, bare, size = 0, [], False, 0
        for unsplit, piece in _pieces(own, text, spread):
            if held and (unsplit != bare or size + len(piece) > spread):
                yield part, 0, bare, held if bare else [b"".join(held)]
                part, held, size = part + 1, [], 0
            if unsplit and len(piece) > spread:
                for node, at in enumerate(range(0, len(piece), spread)):
                    yield part, node, True, [piece[at : at + spread]]
                part += 1
            else:
                bare = unsplit
                held.append(piece)
                size += len(piece)
        if held:
            yield part, 0, bare, held if bare else [b"".join(held)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, leaf)
        for batch in batches:
            for digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                for part, node, bare, pieces in nodes(own, text):
                    arrays = [pa.array([digest], pa.string()), pa.array([part], pa.int64()), pa.array([node], pa.int64()), pa.array([bare], pa.bool_()), pa.array([pieces], pa.list_(pa.binary()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["digest", "part", "node", "bare", "pieces"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, leaf)
        for batch in batches:
            ids = [b"".join(np.array(own.tree(x), "<u4").tobytes() if bare else own.encode(x.decode()) for x in pieces) for bare, pieces in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["digest", "part", "node", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, leaf)
        for batch in batches:
            ids = [np.array(functools.reduce(own.join, [np.frombuffer(x["ids"], "<u4").tolist() for x in two]), "<u4").tobytes() for two in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["digest", "part", "node", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join([x["ids"] for x in parts]) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["digest", "ids"])

    shape = "digest string, part long, node long, ids binary"
    rows = scratch.write(texts.mapInArrow(cut, "digest string, part long, node long, bare boolean, pieces array<binary>"), "parts")
    most = rows.agg(F.max("node")).first()[0] + 1
    now = rows.repartition(F.xxhash64("digest", "part", "node")).mapInArrow(leaves, shape)
    single = now
    if most > 1:
        several = rows.filter("node > 0").select("digest", "part").distinct()
        now = scratch.write(now, "leaves")
        single = now.hint("merge").join(several, ["digest", "part"], "left_anti")
        now = now.hint("merge").join(several, ["digest", "part"], "left_semi").select("digest", "part", "node", "ids")
        while most > 1:
            # two neighbours at most in each group
            two = now.groupBy("digest", "part", F.expr("node div 2").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "ids"))).alias("two"))
            now = two.mapInArrow(joined, shape)
            most = -(-most // 2)
        single = single.select("digest", "part", "node", "ids").union(now)
    parts = single.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return scratch.write(parts.mapInArrow(whole, "digest string, ids binary"), "ids")


def decode(coded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", name: str = FILE) -> DataFrame:
    """The rows with the text of their ids in place of these; special tokens are kept."""
    others = [c for c in coded.columns if c != ids_col]
    shape = coded.select(*others).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name)
        for batch in batches:
            texts = pa.array([own.decode(i or b"") for i in batch.column(len(others)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*others, text_col])

    return coded.select(*others, ids_col).mapInArrow(run, shape)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded."""
    coded = encode(docs, id_col, text_col, decoded_col="decoded")
    return coded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
