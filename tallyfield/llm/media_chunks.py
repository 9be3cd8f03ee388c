"""Payloads in a store of content-defined chunks.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of UNIT, are 8-bit samples. A rolling gear hash over the last 32
bytes cuts them where its top bits are zero, so equal passages give equal chunks wherever they stand. Chunk digests are counted by Spark; a chunk
that occurs once is stored with its payload, one that occurs more often goes to a table with one row per digest. A recipe (the ordered
digests) rebuilds a payload; rebuilt bytes are checked against the payload's digest.

Which digests occur more often is told to the tasks by a bitmap of at most 2**BITMAP bits, so its size is bounded. A digest that only shares a bit with such
a one takes the shared path too, which is right for any digest; a full bitmap costs movement, not correctness.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, slices, text_array, texts_of
from tallyfield.llm.words import mix
from tallyfield.session import scratch_path

UNIT = 192
LEAST, USUAL_BITS, MOST = 512, 11, 16_384
BITMAP = 26
_GEAR = (mix(np.arange(301, 557, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over k < 32, modulo 2**32, by doubling the window five times."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        older = h[:-s] << np.uint32(s)
        h[s:] += older
    return h


def chunk_ends(cuts: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of [start, end): behind the first cut place that makes a chunk of LEAST bytes, after MOST bytes otherwise."""
    out, p = [], start
    while p < end:
        k = bisect_left(cuts, p + LEAST - 1)
        stop = min(p + MOST, end)
        p = cuts[k] + 1 if k < len(cuts) and cuts[k] + 1 < stop else stop
        out.append(p)
    return out


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def chunked(payloads: list[bytes]) -> list[list[bytes]]:
    """Chunks of every payload; a payload's first LEAST bytes hold no cut, so neighbours in the buffer don't matter."""
    whole = b"".join(payloads)
    cuts = np.flatnonzero(gear_hashes(np.frombuffer(whole, np.uint8)) >> np.uint32(32 - USUAL_BITS) == 0).tolist()
    out, at = [], 0
    for p in payloads:
        ends = chunk_ends(cuts, at, at + len(p))
        out.append([whole[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)])
        at += len(p)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _payloads(rb, lo, hi):
    raw = [x.as_buffer() for x in rb[lo:hi]]
    sizes = [x.size if x else 0 for x in raw]
    return sizes, [payload_of(x.to_pybytes() if x else b"") for x in raw]


def _recipes(batches):
    for rb in batches:
        texts = text_array(rb.column("text"))
        for lo, hi in slices(texts):
            sizes, payloads = _payloads(texts, lo, hi)
            yield batch(["doc_id", "n_bytes", "payload_bytes", "media", "digests"],
                        [rb.column("doc_id")[lo:hi], sizes, [len(p) for p in payloads], [digest(p) for p in payloads],
                         [[digest(c) for c in chunks] for chunks in chunked(payloads)]],
                        [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())])


def bit_of(d: bytes) -> int:
    return int.from_bytes(d[:4], "big") >> (32 - BITMAP)


def shared_bits(recipes: DataFrame) -> bytes:
    """Bitmap with the bits of all digests that occur more than once."""
    often = (recipes.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1"))
    place = F.shiftrightunsigned(F.conv(F.hex(F.substring("d", 1, 4)), 16, 10).cast("long"), 32 - BITMAP)
    parts = (often.select((place / 32768).cast("long").alias("part"), (place % 32768).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")))  # 2**BITMAP / 32768 rows at most
    out = bytearray(1 << (BITMAP - 3))
    for r in parts.collect():
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def _is_set(bits: bytes, d: bytes) -> bool:
    b = bit_of(d)
    return bool(bits[b >> 3] >> (b & 7) & 1)


def _own_chunks(packed):
    """A row per payload with the chunks that occur nowhere else."""
    def run(batches):
        bits = zlib.decompress(packed.value)
        for rb in batches:
            texts = text_array(rb.column("text"))
            for lo, hi in slices(texts):
                _, payloads = _payloads(texts, lo, hi)
                rows = []
                for p, chunks in zip(payloads, chunked(payloads), strict=True):
                    own = [(k, c) for k, c in enumerate(chunks) if not _is_set(bits, digest(c))]
                    if own:
                        rows.append((digest(p), len(chunks), [k for k, _ in own], [c for _, c in own]))
                cols = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 4
                yield batch(["media", "total", "places", "chunks"], cols, [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary())])
    return run


def _shared_chunks(packed):
    """digest and bytes of the other chunks, each once for a slice."""
    def run(batches):
        bits = zlib.decompress(packed.value)
        for rb in batches:
            texts = text_array(rb.column("text"))
            for lo, hi in slices(texts):
                _, payloads = _payloads(texts, lo, hi)
                found = {d: c for chunks in chunked(payloads) for c in chunks if _is_set(bits, d := digest(c))}
                yield batch(["digest", "bytes"], [list(found), list(found.values())], [pa.binary(), pa.binary()])
    return run


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``recipes``, ``own`` and ``shared`` below ``path``, which must not exist.

    Rows that repeat a text share its recipe and chunks. A null text counts as empty; its payload is UNIT spaces.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows.mapInArrow(_recipes, "doc_id long, n_bytes long, payload_bytes long, media binary, digests array<binary>"
                    ).write.option("compression", "zstd").parquet(f"{path}/recipes")
    packed = spark.sparkContext.broadcast(zlib.compress(shared_bits(spark.read.parquet(f"{path}/recipes"))))
    texts = rows.select("text")
    texts.mapInArrow(_own_chunks(packed), "media binary, total int, places array<int>, chunks array<binary>"
                     ).write.option("compression", "zstd").parquet(f"{path}/own")
    (texts.mapInArrow(_shared_chunks(packed), "digest binary, bytes binary").dropDuplicates(["digest"])
     .write.option("compression", "zstd").parquet(f"{path}/shared"))
    packed.unpersist()


def stored_form(chunks: list[bytes]) -> bytes:
    """Each chunk behind its length (4 bytes, little-endian)."""
    return b"".join(part for c in chunks for part in (len(c).to_bytes(4, "little"), c))


def features(payload: bytes, chunks: int) -> str:
    """Chunks, mean, deviation and entropy of the samples, and the share of spaces."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n[n > 0] / len(payload)
    mean = float(n @ np.arange(256)) / len(payload)
    spread = max(0.0, float(n @ np.arange(256) ** 2) / len(payload) - mean * mean) ** 0.5
    return f"chunks={chunks};mean={mean:.4f};dev={spread:.4f};bits={float(-(p * np.log2(p)).sum()):.4f};blank={n[32] / len(payload):.4f}"


def _rebuilt(batches):
    for rb in batches:
        rows = []
        for media, places, chunks in zip(*(rb.column(c).to_pylist() for c in ("media", "places", "chunks")), strict=True):
            ordered = [c for _, c in sorted(zip(places, chunks, strict=True), key=lambda x: x[0])]
            payload = b"".join(ordered)
            if digest(payload) != media:
                raise ValueError(f"stored chunks do not give payload {media.hex()}")
            form = stored_form(ordered)
            rows.append((media, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(form),
                         hashlib.sha256(form).hexdigest(), features(payload, len(ordered))))
        cols = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 6
        yield batch(["media", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], cols,
                    [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def payload_chunks(spark, path: str) -> DataFrame:
    """media, places, chunks of every different payload of the store at ``path``: what its own row holds and what the recipe names."""
    own = spark.read.parquet(f"{path}/own")
    whole = own.where(F.size("places") == F.col("total")).select("media", "places", "chunks")
    recipes = spark.read.parquet(f"{path}/recipes")
    wanted = recipes.select("media", F.posexplode("digests").alias("place", "digest")).distinct()
    fetched = wanted.join(spark.read.parquet(f"{path}/shared"), "digest").select(
        "media", F.array("place").alias("places"), F.array("bytes").alias("chunks"))
    parts = fetched.unionByName(own.where(F.size("places") < F.col("total")).select("media", "places", "chunks"))
    joined = parts.groupBy("media").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("chunks")).alias("chunks"))
    return whole.unionByName(joined)


def read_store(spark, path: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and what the stored bytes of its payload give when read back, for every stored row."""
    back = payload_chunks(spark, path).mapInArrow(
        _rebuilt, "media binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return (spark.read.parquet(f"{path}/recipes").drop("digests").join(back, "media", "left")
            .select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``write_store`` to the shared folder, then ``read_store``."""
    path = scratch_path(docs.sparkSession, "media")
    write_store(docs, path, id_col, text_col)
    return read_store(docs.sparkSession, path)
