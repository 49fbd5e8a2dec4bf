"""Token-id output into a content-addressed store.

A store is a folder of the shared file system:

    packs/*.ids     chunks of token ids, little-endian, one after the other; each chunk is stored once
    recipes/        Parquet, in ascending order of the documents' ids: start, n_tokens, the Merkle root of the
                    document and the places (pack, offset, length, hash) of its chunks
    manifest/       Parquet: Merkle roots over blocks of documents, over blocks of those, and so on up to one

Rolling hashes over the ids cut a document into chunks, so that equal passages give equal chunks wherever they
stand. Tasks first write draft packs, each chunk once a task; then the place of each chunk that comes first
is its owner, and the owned chunks are copied into the final packs, in waves, each of which frees its drafts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, pinned, release

END_ID = 0
#: Chunks: least, usual and most ids; and how many ids the rolling hash spans.
LEAST, USUAL, MOST, SPAN = 128, 512, 2048, 8
WAVES = 4
#: Texts are encoded together up to about so many bytes.
SLICE_BYTES = 1 << 20
#: Documents under one Merkle root of the manifest's lowest level, and roots under one of the next.
BLOCK = 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = "array<struct<hash: binary, pack: string, at: bigint, size: int>>"


# Tokenizing


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Encodes texts with a tokenizers file, remembering the ids of pieces.

    Byte-level BPE with its usual pattern never merges across these places, so the ids of a text are those of its pieces,
    which recur: before a blank that a visible character follows; around a line end between two visible characters;
    between letters and the marks after them. Files of any other kind encode whole texts.
    """

    #: Pieces to remember, of CACHED_CHARS characters at most: some 50 MB a worker, whatever the corpus.
    CACHED, CACHED_CHARS = 300_000, 30
    LINE = re.compile(r"(?<=\S)\n(?=[!-~\w])")
    BLANK = re.compile(r" (?=[!-~\w])")
    PLAIN = re.compile(r"\S+")
    #: Latin letters and then ASCII marks but the apostrophe, which can begin a token of its own.
    WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")
    #: A blank that no visible character follows, or one at the end (RE2 syntax).
    ODD = r" ([^!-~\pL\pN]|$)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.end = np.array([END_ID], self.type).tobytes()
        self.by_pieces = self.is_usual(path)
        # How the file's pre-tokenizer writes the bytes of letters.
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.written = {ord(c): shown(c)[0][0] for c in [" ", *map(chr, range(0xC0, 0x250))]}

    def is_usual(self, path: str) -> bool:
        """Whether the file is byte-level BPE with the usual pattern, and no added token or setting that looks beyond pieces."""
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        kind, cutter = read["model"], read.get("pre_tokenizer") or {}
        usual = kind.get("type") == "BPE" and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        usual = usual and not kind.get("dropout") and not read.get("normalizer") and not read.get("truncation") and not read.get("padding")
        return usual and all(self.PLAIN.fullmatch(t["content"]) and not self.WORD.search(t["content"][:1]) and not t.get("lstrip") and not t.get("rstrip") for t in read.get("added_tokens", ()))

    def whole(self, strings: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def marked(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) > 50_000:
                self.marks = {"": b""}
            found = self.marks[marks] = self.whole([marks])[0]
        return found

    def learn(self, known: dict[str, bytes], prefix: str, new: list[str]) -> list[bytes]:
        """The ids of some pieces that are not known, each behind the prefix; short ones are remembered while there is room."""
        out: list[bytes | None] = [None] * len(new)
        rest, lines = [], []
        match, tokenize, written, code = self.WORD.fullmatch, self.tokenizer.model.tokenize, self.written, self.code
        room = self.CACHED - len(self.bare) - len(self.spaced)
        before = prefix.translate(written)
        for i, x in enumerate(new):
            if found := match(x):
                letters, marks = found.groups()
                ids = known.get(letters) if marks else None
                if ids is None:
                    shown = letters if letters.isascii() else letters.translate(written)
                    ids = array(code, [t.id for t in tokenize(before + shown)]).tobytes()
                out[i] = ids + self.marked(marks) if marks else ids
                if room > 0 and len(x) <= self.CACHED_CHARS:
                    known[x] = out[i]
                    room -= 1
            elif "\n" in x and len(parts := self.LINE.split(x)) > 1 and all(map(self.PLAIN.fullmatch, parts)):
                lines.append((i, parts))
            else:
                rest.append(i)
        for i, ids in zip(rest, self.whole([prefix + new[i] for i in rest]) if rest else ()):
            out[i] = ids
            if room > 0 and len(new[i]) <= self.CACHED_CHARS:
                known[new[i]] = ids
                room -= 1
        if lines:
            heads = self.of(known, prefix, [parts[0] for _, parts in lines])
            tails = iter(self.of(self.bare, "", [y for _, parts in lines for y in parts[1:]]))
            end = self.marked("\n")
            for (i, parts), head in zip(lines, heads):
                out[i] = end.join([head, *(next(tails) for _ in parts[1:])])
        return out

    def of(self, known: dict[str, bytes], prefix: str, pieces: list[str]) -> list[bytes]:
        """The ids of pieces behind the prefix."""
        out = list(map(known.get, pieces))
        new = list({x for x, ids in zip(pieces, out) if ids is None})
        if new:
            found = dict(zip(new, self.learn(known, prefix, new)))
            out = [found[x] if ids is None else ids for x, ids in zip(pieces, out)]
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, with END_ID at the end.

        Arrow cuts the texts at blanks and numbers the distinct pieces; each of those is looked up or encoded once,
        and their ids are put together with numpy. Texts with other blanks than single ones between words are cut by a pattern instead.
        """
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_pieces:
            return [np.frombuffer(ids + self.end, self.type) for ids in self.whole(column.to_pylist())]
        odd = pc.match_substring_regex(column, self.ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(odd).tolist(), self.by_pattern(column.filter(pa.array(odd)).to_pylist())):
            out[i] = ids
        plain = np.flatnonzero(~odd)
        if len(plain):
            lists = pc.split_pattern(column.filter(pa.array(~odd)), " ")
            codes = lists.flatten().dictionary_encode()
            names, codes = codes.dictionary.to_numpy(zero_copy_only=False).tolist(), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            heads, at = np.unique(codes[starts], return_inverse=True)
            # Pieces after a blank, then pieces at the start of a text, then the end.
            data = [*self.of(self.spaced, " ", names), *self.of(self.bare, "", [names[i] for i in heads.tolist()]), self.end]
            codes[starts] = len(names) + at
            codes = np.insert(codes, starts + sizes, len(data) - 1)
            flat = np.frombuffer(b"".join(data), self.type)
            lengths = np.fromiter(map(len, data), np.int64, len(data)) // self.type.itemsize
            first = np.cumsum(lengths) - lengths
            each = lengths[codes]
            upto = np.cumsum(each)
            ids = flat[np.repeat(first[codes] - (upto - each), each) + np.arange(upto[-1])]
            ends = upto[np.cumsum(sizes + 1) - 1].tolist()
            for i, a, b in zip(plain.tolist(), [0, *ends], ends):
                out[i] = ids[a:b]
        return out

    def by_pattern(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.BLANK.split(x) for x in texts]
        heads = self.of(self.bare, "", [x[0] for x in cut])
        rest = iter(self.of(self.spaced, " ", [y for x in cut for y in x[1:]]))
        return [np.frombuffer(b"".join((h, *(next(rest) for _ in x[1:]), self.end)), self.type) for h, x in zip(heads, cut)]


# Chunks and roots


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = np.zeros(n - SPAN + 1, np.uint64)
    for i in range(SPAN):
        h = h * MULTIPLIER + ids[i : i + len(h)].astype(np.uint64)
    marks = np.flatnonzero((h * MULTIPLIER) >> np.uint64(64 - (USUAL - LEAST).bit_length()) == 0) + SPAN
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n:
            if m > last:
                out.append(m)
            last = m
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over some digests; an odd last one goes up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


# Writing


@dataclass
class Store:
    """path: the folder; kind: the numpy type of an id in its packs."""

    path: str
    kind: str


def places(rows: list[list[tuple[bytes, str, int, int]]]) -> pa.Array:
    """Lists of (hash, pack, at, size) as an Arrow column."""
    columns = list(zip(*(x for row in rows for x in row)))
    fields = [("hash", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())]
    values = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = upto // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def drafts(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """row (a number), ident, n_tokens, root and chunks of each document, with the chunks in draft packs."""
    kind = docs.schema["ident"].dataType.simpleString()

    def run(batches):
        context = TaskContext.get()
        part = context.partitionId()
        store, base = fs.FileSystem.from_uri(f"{folder}/{part % WAVES}")
        store.create_dir(base, recursive=True)
        name, at, row = f"{part % WAVES}/{part:06d}-{context.taskAttemptId()}.ids", 0, part << 40
        seen: dict[bytes, tuple[int, int]] = {}
        with store.open_output_stream(f"{base}/{name.split('/')[1]}", compression=None) as out:
            encode = encoder(tokenizer).encode
            for batch in batches:
                for some in slices(batch):
                    rows, counts = [], []
                    for ids in encode(pc.fill_null(some.column("text"), "")):
                        chunks, last = [], 0
                        for end in cuts(ids):
                            data = ids[last:end].tobytes()
                            last = end
                            h = digest(data)
                            if h not in seen:
                                out.write(data)
                                seen[h] = at, len(data)
                                at += len(data)
                            chunks.append((h, name, *seen[h]))
                        rows.append(chunks)
                        counts.append(len(ids))
                    numbers = list(range(row, row + len(rows)))
                    row += len(rows)
                    roots = [merkle([c[0] for c in chunks]) for chunks in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), some.column("ident"), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), places(rows)], names=["row", "ident", "n_tokens", "root", "chunks"])

    return pinned(docs.mapInArrow(run, f"row bigint, ident {kind}, n_tokens bigint, root binary, chunks {CHUNKS}"))


class Packs:
    """Reads chunks out of packs, with some of the files kept open."""

    def __init__(self, folder: str, limit: int = 32):
        self.folder, self.limit, self.files = folder, limit, {}

    def read(self, pack: str, at: int, size: int) -> bytes:
        if pack not in self.files:
            if len(self.files) >= self.limit:
                self.files.pop(next(iter(self.files))).close()
            store, path = fs.FileSystem.from_uri(f"{self.folder}/{pack}")
            self.files[pack] = store.open_input_file(path)
        data = self.files[pack].read_at(size, at)
        if len(data) != size:
            raise ValueError(f"{pack} ends before {at + size}")
        return data


def compact(owners: DataFrame, draft: str, final: str, partitions: int) -> DataFrame:
    """Copy the owned chunks (hash, pack, at, size) from draft packs to final ones; their new places."""

    def run(batches):
        context = TaskContext.get()
        source, out, at = Packs(draft), None, 0
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        try:
            for batch in batches:
                if out is None:
                    store, base = fs.FileSystem.from_uri(final)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                offsets = []
                for pack, old, size in zip(*(batch.column(c).to_pylist() for c in ("pack", "at", "size"))):
                    out.write(source.read(pack, old, size))
                    offsets.append(at)
                    at += size
                yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([name] * len(offsets)), pa.array(offsets, pa.int64()), batch.column("size")], names=["hash", "pack", "at", "size"])
        finally:
            if out is not None:
                out.close()

    dealt = owners.repartition(partitions, "pack").sortWithinPartitions("pack", "at")
    return pinned(dealt.mapInArrow(run, "hash binary, pack string, at bigint, size int"))


def in_order(rows: DataFrame, partitions: int) -> DataFrame:
    """rows (ident, n_tokens, root, ...) in ascending order of ident, nulls first, with ordinal and start."""
    ordered = pinned(rows.repartitionByRange(partitions, F.col("ident").asc_nulls_first(), "root").sortWithinPartitions(F.col("ident").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id()))
    # A row for each partition goes through the driver.
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("part").collect()
    before, tokens, count = {}, 0, 0
    for r in sums:
        before[r["part"]] = tokens, count
        tokens, count = tokens + r["tokens"], count + r["rows"]

    def run(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = at or before[batch.column("part")[0].as_py()]
            n = batch.column("n_tokens").to_numpy()
            starts = at[0] + np.concatenate([[0], np.cumsum(n)[:-1]])
            ordinals = at[1] + np.arange(len(n))
            at = at[0] + int(n.sum()), at[1] + len(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ordinals), pa.array(starts)], names=[*batch.schema.names, "ordinal", "start"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.mapInArrow(run, f"{fields}, ordinal bigint, start bigint")


def manifest(recipes: DataFrame) -> DataFrame:
    """level, block, root: level 0 over documents in order, each next level over the blocks of the one before."""

    def up(rows: DataFrame, level: int) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "root"))), lambda x: F.hex(x["root"])), "")
        return rows.groupBy(F.floor(F.col("ordinal") / BLOCK).cast("bigint").alias("block")).agg(F.unhex(F.sha2(joined, 256)).alias("root")).select(F.lit(level).alias("level"), "block", "root")

    out = pinned(up(recipes.select("ordinal", "root"), 0))
    last, level = out, 0
    while last.count() > 1:
        level += 1
        last = pinned(up(last.select(F.col("block").alias("ordinal"), "root"), level))
        out = out.unionByName(last)
    return out


def write(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text") -> Store:
    """Encode all documents into a new store.

    Null texts count as empty; each document ends with END_ID, so an empty one has that id alone. Null idents come
    first; repeated rows are documents of their own, in the order of their roots; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    path = new_dir(spark, "tokens")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = drafts(docs.select(docs[ident].alias("ident"), docs[text].alias("text")), f"{path}/draft", tokenizer)
    place = F.explode("chunks").alias("c")
    owners = rows.select(place).groupBy("c.hash").agg(F.min(F.struct("c.pack", "c.at", "c.size")).alias("o"))
    owners = pinned(owners.select("hash", "o.*"))
    release(spark)
    index = None
    for wave in range(WAVES):
        part = compact(owners.where(F.col("pack").startswith(f"{wave}/")), f"{path}/draft", f"{path}/packs", partitions)
        release(spark)
        store, base = fs.FileSystem.from_uri(f"{path}/draft/{wave}")
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)
        index = part if index is None else index.unionByName(part)
    chunks = rows.select("row", F.posexplode("chunks").alias("seq", "c")).select("row", "seq", F.col("c.hash").alias("hash"))
    placed = chunks.join(index, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "hash", "pack", "at", "size"))).alias("places"))
    placed = placed.select("row", F.transform("places", lambda x: F.struct(x["hash"].alias("hash"), x["pack"].alias("pack"), x["at"].alias("at"), x["size"].alias("size"))).alias("chunks"))
    recipes = rows.drop("chunks").join(placed, "row").select("ident", "n_tokens", "root", "chunks")
    in_order(recipes, partitions).drop("part").write.parquet(f"{path}/recipes")
    release(spark)
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    kind = encoder(tokenizer).type.str
    return Store(path, kind)


# Reading


def check_manifest(spark: SparkSession, store: Store) -> None:
    """Raise ValueError unless the recipes have the roots that the manifest gives."""
    kept = spark.read.parquet(f"{store.path}/manifest")
    now = manifest(spark.read.parquet(f"{store.path}/recipes"))
    if kept.exceptAll(now).unionByName(now.exceptAll(kept)).count():
        raise ValueError(f"{store.path}: the recipes do not match the manifest")


def read(spark: SparkSession, store: Store, with_ids: bool = False) -> DataFrame:
    """ident, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and, if asked for, ids of every document.

    Documents are put together from their chunks; a chunk, document or manifest that does not match its hash raises ValueError.
    """
    check_manifest(spark, store)
    recipes = spark.read.parquet(f"{store.path}/recipes").select("ident", "start", "n_tokens", "root", "chunks")
    kind = recipes.schema["ident"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Packs(f"{store.path}/packs")
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                sums, ids = [], []
                for ident, n, root, chunks in zip(*(batch.column(c).to_pylist() for c in ("ident", "n_tokens", "root", "chunks"))):
                    data = [packs.read(c["pack"], c["at"], c["size"]) for c in chunks]
                    hashes = [digest(x) for x in data]
                    values = np.frombuffer(b"".join(data), store.kind).astype("<u4")
                    if hashes != [c["hash"] for c in chunks] or merkle(hashes) != root or len(values) != n:
                        raise ValueError(f"document {ident} does not match its recipe")
                    sums.append(zlib.crc32(values.tobytes()))
                    ids.append(values if with_ids else None)
                columns = [batch.column("ident"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())]
                names = ["ident", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return recipes.mapInArrow(run, f"ident {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
