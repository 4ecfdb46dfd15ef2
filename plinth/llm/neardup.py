"""MinHash near-duplicates: hash minima, banding, signature and exact checks, components.

1. Each text becomes its set of distinct word shingles (64-bit hashes).
   Documents with one and the same set are one class, stood for by the least id.
2. A class's signature is the minima of BANDS * ROWS universal hashes
   a * x + b modulo 2**64. Each band of ROWS minima is a bucket key. A pair at
   0.85 is in no common bucket, or falls to the comparison of signatures below,
   with a probability under one in two million.
3. In each bucket, members are compared with one member, its centre, by
   signature and then by the full sets of their texts. Linked members merge
   into components by alternating large-star and small-star. Buckets that then
   still hold several components are gone through in blocks of bounded size,
   comparing only members of different components, by signature and 32-bit
   shingle hashes inside the task; what is left is confirmed on full sets. So
   every link found by banding counts, but no bucket's pairs are written out.

Empty or null texts have no shingles and no links. Where ids are null or
repeated, each row is a document of its own, and a component goes by the least
id in it that is not null, or null. Texts of any length are gone through
whole. An empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import aside, cut, ids_tell_rows, if_small, told_apart, with_row_keys
from plinth.llm.components import components
from plinth.llm.shingles import mix, shingle_sets

BANDS, ROWS = 25, 5
#: Standard deviations by which a signature may fall short before the exact check.
SLACK = 6.5
_RNG = np.random.RandomState(7)
_A = (_RNG.randint(1, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.randint(0, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    least = np.full(len(_A), np.uint64(2**64 - 1))
    work = np.empty((len(_A), 256), np.uint64)
    for i in range(0, len(shingles), 256):
        part = shingles[i : i + 256]
        values = work[:, : len(part)]
        np.multiply(_A[:, None], part[None, :], out=values)
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, n_shingles, set key (16 bytes), 32-bit signature and band keys of each row, in one pass over the texts."""
    for batch in batches:
        sizes, sets, signed, keys = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            if not len(s):
                sets.append(None)
                signed.append(None)
                keys.append(None)
                continue
            least = minima(s)
            sets.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes())
            signed.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
            keys.append(band_keys(least))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(signed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "n_shingles", "set_key", "signature", "keys"])


def _short_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, its shingles as 32-bit hashes (a collision counts as shared)."""
    for batch in batches:
        made = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["rep", "shingles"])


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For rows of signatures: whether the estimate leaves the threshold possible."""
    t = percent / 100
    cut_at = t - SLACK * np.sqrt(t * (1 - t) / a.shape[-1])
    return (a == b).mean(axis=-1) >= cut_at


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 256, broadcast_ids: int = 500_000, unique_ids: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; linked at 100 * shared >= percent * union.

    `unique_ids` says that ids are known to tell rows apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_own"), F.col(text_col).alias("_text"))
    rows, same = (rows.withColumn("_id", F.col("_own")), True) if unique_ids else told_apart(rows, "_own", "_id")
    texts = rows.select("_id", "_text")
    sets = cut(texts.mapInArrow(_signatures, "_id long, n_shingles long, set_key binary, signature binary, keys array<long>"))
    classes = sets.where("n_shingles > 0").groupBy("set_key").agg(F.min_by(F.struct("_id", "n_shingles", "signature", "keys"), "_id").alias("_of"))
    classes = cut(classes.select("set_key", "_of.*").withColumnRenamed("_id", "rep"))
    short = classes.select(F.col("rep"), F.col("n_shingles").alias("n"), "signature")
    in_buckets = classes.select(F.explode_outer("keys").alias("key"), "rep")

    def checked(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that the full sets confirm; only the texts they name are moved."""
        pairs = cut(pairs)
        named = if_small(pairs.select(F.explode(F.array("u", "v")).alias("_id")).distinct(), broadcast_ids)
        held = cut(texts.join(named, "_id", "left_semi"))
        left = pairs.join(held.select(F.col("_id").alias("u"), F.col("_text").alias("left")), "u")
        return left.join(held.select(F.col("_id").alias("v"), F.col("_text").alias("right")), "v").select("u", "v", "left", "right").mapInArrow(confirm, "u long, v long")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    def by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            mask = pa.array(alike(a, b, percent) if batch.num_rows else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    # One comparison for each bucket member, with the bucket's least class.
    centres = in_buckets.groupBy("key").agg(F.min("rep").alias("u"), F.count("*").alias("size")).where("size > 1")
    shared = cut(in_buckets.join(centres, "key"))
    starred = cut(shared.where("rep <> u").select("u", F.col("rep").alias("v")).distinct())
    sized = starred.join(short.toDF("u", "n_u", "s_u"), "u").join(short.toDF("v", "n_v", "s_v"), "v")
    fits = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    likely = sized.where(fits).select("u", "v", "s_u", "s_v").mapInArrow(by_signature, "u long, v long")
    links = cut(checked(likely))
    found = components(links)

    # Buckets that hold several components beyond their centre's comparisons.
    labelled = shared.where("size > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = labelled.where("rep <> u").groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
    rest = cut(labelled.where("rep <> u").join(open_keys.select("key"), "key").select("key", "rep", "component", "size"))
    joined = found
    if not rest.isEmpty():
        named = if_small(rest.select(F.col("rep").alias("_id")).distinct(), broadcast_ids)
        hashed = texts.join(named, "_id", "left_semi").mapInArrow(_short_hashes, "rep long, shingles binary")
        payload = short.join(hashed, "rep").join(classes.select("rep", "keys"), "rep")
        parts = rest.groupBy("key", "component").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max(F.struct("_n", "component")).alias("_top"), F.sum("_n").alias("_all"))
        number = lambda n: F.greatest(F.ceil(n / block).cast("int"), F.lit(1))
        parts = parts.select("key", F.col("_top.component").alias("_largest"), number(F.col("_top._n")).alias("_large"), number(F.col("_all") - F.col("_top._n")).alias("_small"))
        placed = rest.join(parts, "key").withColumn("_is_large", F.col("component") == F.col("_largest"))
        placed = placed.withColumn("_own", F.pmod(F.xxhash64("rep"), F.when(F.col("_is_large"), F.col("_large")).otherwise(F.col("_small"))).cast("int"))
        # A small block meets every small and every large block; a large block meets the small ones.
        with_small = F.transform(F.sequence(F.lit(0), F.col("_small") - 1), lambda x: F.struct(F.least("_own", x).alias("_i"), F.greatest("_own", x).alias("_j"), F.lit(False).alias("_at_large")))
        with_large = F.transform(F.sequence(F.lit(0), F.col("_large") - 1), lambda x: F.struct(F.col("_own").alias("_i"), x.alias("_j"), F.lit(True).alias("_at_large")))
        of_large = F.transform(F.sequence(F.lit(0), F.col("_small") - 1), lambda x: F.struct(x.alias("_i"), F.col("_own").alias("_j"), F.lit(True).alias("_at_large")))
        dealt = placed.withColumn("_to", F.explode(F.when(F.col("_is_large"), of_large).otherwise(F.concat(with_small, with_large))))
        dealt = dealt.select("key", "_to.*", "_own", "_is_large", "rep", "component").join(payload, "rep")

        def cross(pdf: pd.DataFrame) -> pd.DataFrame:
            """Pairs of different components between two blocks of a bucket that their short hashes link.

            A pair is looked at in the first band that it shares. Short hashes can
            only make sets more alike, so no link is lost; the full sets decide.
            """
            sig = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), -1)
            bands = np.stack(pdf["keys"].to_numpy())
            ids, comp, n, own = (pdf[c].to_numpy() for c in ("rep", "component", "n", "_own"))
            sets = [np.frombuffer(x, np.uint32) for x in pdf["shingles"]]
            key, i, j, at_large = (pdf[c].iat[0] for c in ("key", "_i", "_j", "_at_large"))
            large = pdf["_is_large"].to_numpy(bool)
            rows, cols = np.flatnonzero((own == i) & ~large), np.flatnonzero((own == j) & (large == at_large))
            out = []
            for a in rows:
                near = cols[(comp[cols] != comp[a]) & ((ids[cols] > ids[a]) if i == j and not at_large else True)]
                near = near[np.minimum(n[near], n[a]) * 100 >= np.maximum(n[near], n[a]) * percent]
                if len(near):
                    same = bands[near] == bands[a]
                    near = near[bands[a][same.argmax(axis=1)] == key]
                if len(near):
                    near = near[alike(sig[near], sig[a][None, :], percent)]
                for b in near:
                    shared = np.isin(sets[a], sets[b]).sum()
                    if 100 * shared >= percent * (n[a] + n[b] - shared):
                        out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
            return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

        late = cut(checked(dealt.groupBy("key", "_i", "_j", "_at_large").applyInPandas(cross, "u long, v long").distinct()))
        if not late.isEmpty():
            joined = components(links.unionByName(late))

    of_class = classes.select("set_key", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sets.select("_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    out = out.select("_id", "n_shingles", F.coalesce("component", "_id").alias("component"))
    if same:
        out = out.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        named = out.join(rows.select("_id", "_own"), "_id")
        least = named.groupBy("component").agg(F.min("_own").alias("component_id"))
        out = named.join(least, "component").select(F.col("_own").alias("doc_id"), "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` that are kept, with their columns, whatever their names.

    One of equal rows stays. If ids are null or repeated, each other row is a
    document of its own, and the least id that is not null stands for a group.
    """
    key, (rows, back) = "doc_id", aside(docs, "doc_id", "text")
    if not ids_tell_rows(docs, key):
        key, parts = "_row", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64(*rows.columns)]
        rows = with_row_keys(rows.distinct().repartitionByRange(parts, *order).sortWithinPartitions(*order), key)
    gone = near_duplicates(rows, id_col=key, unique_ids=True, **options).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return back(rows.join(if_small(gone, options.get("broadcast_ids", 500_000)), key, "left_anti"))
