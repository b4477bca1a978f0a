"""Operator 9, n-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each distinct set of shingles (equal sets are one row, so a group
of copies of any size costs one) and a column for each shingle. Columns are dealt into hash blocks.

1. A first group of column blocks (`FIRST_OF_8` eighths of all shingles, by hash) is multiplied out as
   far as counts: how many of a row's entries there meet an entry of another row (of a column that a task has often, two
   entries travel and the others are counted where they are). A link of Jaccard t
   needs an overlap of t times the larger set, so a row with more than (1 - t) n unmatched entries is
   discarded, exactly. Mostly unique texts go here.
2. The rows left are multiplied out over all columns and discarded by the same bound. For what still
   remains, pairs come from the (1 - t) n + 1 rarest columns of each row: two linked rows share one of
   them, and from their first common column on each has as many entries left as they need. Each column first meets only its most shared row of a like size
   (a star instead of all pairs); overlaps are counted on the whole sets.
3. Rows that the stars joined need no more pairs among themselves: what is left are pairs of one
   column whose rows are in different components, in bounds. They are counted as well, so no link is
   lost; the components of all links are the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import Work, fresh, join_checked

FIRST_OF_8 = 3
FLUSH = 1 << 20
#: Blocks of columns for each task of the product: tasks come out even, and one block is unpacked at a time.
BLOCKS_PER_TASK = 4
#: Entries of the first blocks that one task of the product takes. Each task gives a partial count for each row it meets, so larger tasks give fewer.
TASK_ENTRIES = 4 << 20


def _sig(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-free 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(g ^ np.uint64(0x5851F42D4C957F2D)))])
        n = np.diff(first).astype(np.uint64)
        return W.mix(total[first[1:]] - total[first[:-1]] + n * np.uint64(0x9E3779B97F4A7C15))


def _first_blocks(g: np.ndarray) -> np.ndarray:
    return (g & np.uint64(7)) < np.uint64(FIRST_OF_8)


def _row_scan(k: int, lower: bool):
    def run(batches):
        for b in W.chunks(batches, "text"):
            g, first = W.shingle_sets(W.split(b.column(1), lower=lower), k)
            m = np.concatenate([[0], np.cumsum(_first_blocks(g))])[first]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(first)), pa.array(np.diff(m)), pa.array(_sig(g, first).view(np.int64))], ["doc_id", "t", "n", "m", "sig"])

    return run


#: Blocks from here on hold counts of entries that met others before the shuffle.
_COUNTED = 1 << 40


def _met_here(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, rows, rows counted): two entries of each column stand for it; the rows of its further ones have met another row already. A column that a third of all rows have leaves a task as two entries."""
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    third = np.zeros(len(h), bool)
    third[2:] = h[2:] == h[:-2]
    return h[~third], row[~third], row[third]


def _packer(bits: int):
    """Entries to rows (block, payload)."""

    def pack(parts):
        h, row, met = _met_here(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        block = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        h, row, block = h[order], row[order], block[order]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            sigs, at = np.unique(row[a:b], return_inverse=True)
            at = at.astype(np.uint16 if len(sigs) <= 1 << 16 else np.uint32)
            low = np.ascontiguousarray(h[a:b]).view(np.uint8).reshape(-1, 8)[:, :6]
            out.append(np.array([len(sigs), b - a], np.uint32).tobytes() + sigs.tobytes() + low.tobytes() + at.tobytes())
        blocks = block[edges[:-1]]
        if len(met):
            sigs, counts = np.unique(met, return_counts=True)
            blocks = np.append(blocks, _COUNTED + int(sigs[0] % np.uint64(1 << 20)))
            out.append(sigs.tobytes() + counts.astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(out, pa.binary())], ["block", "payload"])

    return pack


def _incidence(k: int, lower: bool, bits: int):
    """A task's entries in the first blocks, each distinct set's once a task."""
    pack = _packer(bits)

    def run(batches):
        parts, held, seen = [], 0, np.zeros(0, np.uint64)
        for b in W.chunks(batches, "text"):
            g, first = W.shingle_sets(W.split(b.column(0), lower=lower), k)
            sig, n = _sig(g, first), np.diff(first)
            new = np.zeros(len(sig), bool)
            new[np.unique(sig, return_index=True)[1]] = True
            new &= ~np.isin(sig, seen) & (n > 0)
            seen = np.concatenate([seen, sig[new]])
            keep = np.repeat(new, n) & _first_blocks(g)
            parts.append((g[keep], np.repeat(sig, n)[keep]))
            held += len(parts[-1][0])
            if held >= FLUSH:
                yield pack(parts)
                parts, held = [], 0
        if held:
            yield pack(parts)

    return run


def _product(batches):
    """Of the blocks of a partition: how many entries of each row meet another row. A row that several tasks sent may count twice, never too little."""
    packed, sigs, counts = {}, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in batches:
        for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if block < _COUNTED:
                packed.setdefault(block, []).append(payload)
            else:
                n = len(payload) // 16
                sigs.append(np.frombuffer(payload, np.uint64, n))
                counts.append(np.frombuffer(payload, np.int64, n, 8 * n))
    for block in list(packed):
        row = _meeting(block, packed.pop(block))
        one, n = np.unique(row, return_counts=True)
        sigs.append(one)
        counts.append(n.astype(np.int64))
    one, at = np.unique(np.concatenate(sigs), return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.bincount(at, np.concatenate(counts), len(one)).astype(np.int64))], ["sig", "shared"])
    W.give_back()


def _meeting(block: int, payloads: list[bytes]) -> np.ndarray:
    """The rows of a block's entries whose column another row has, once for each such entry."""
    h, row = [], []
    for raw in payloads:
        n, m = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
        own = np.frombuffer(raw, np.uint64, n, 8)
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, 8 + 8 * n).reshape(m, 6)
        h.append(wide.reshape(-1).view(np.uint64) | np.uint64(block % 65536) << np.uint64(48))
        row.append(own[np.frombuffer(raw, np.uint16 if n <= 1 << 16 else np.uint32, offset=8 + 8 * n + 6 * m)])
    h, row = np.concatenate(h), np.concatenate(row)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    shared = np.zeros(len(h), bool)  # the column has another entry
    shared[1:] |= h[1:] == h[:-1]
    shared[:-1] |= h[1:] == h[:-1]
    h, row = h[shared], row[shared]
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    again = np.zeros(len(h), bool)  # one row from two tasks
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    h, row = h[~again], row[~again]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    return row[np.repeat(size, size) > 1]


def _whole_rows(k: int, lower: bool):
    """The sets of texts that are what their row's signature says; other texts of the same id go."""

    def run(batches):
        for b in W.chunks(batches, "text"):
            g, first = W.shingle_sets(W.split(b.column(1), lower=lower), k)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(g.view(np.int64)))
            own = pa.array(_sig(g, first).view(np.int64) == b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["id", "g"]).filter(own)

    return run


def _in_bounds(n1, left1, n2, left2, percent: int):
    """Whether sets of n1 and n2 may link if they have at most left1 and left2 entries from their first common column on."""
    most = F.least(left1, left2)
    return 100 * most >= percent * (n1 + n2 - most)


def _classes(work: Work, docs: DataFrame, percent: int = 80, k: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, t (hash of the text), n, m and sig; classes: sig, class, component). A set is known by its signature, so one id may have several."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = work.write(texts.withColumn("t", F.xxhash64("text")).mapInArrow(_row_scan(k, lower), "doc_id bigint, t bigint, n bigint, m bigint, sig bigint"), "rows")
    sets = work.write(rows.where("doc_id is not null and n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("m").alias("m")), "sets")

    entries = rows.agg(F.sum("m")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))
    bits = min(20, max(1, (tasks * BLOCKS_PER_TASK - 1).bit_length()))
    blocks = texts.where("doc_id is not null").select("text").mapInArrow(_incidence(k, lower, bits), "block bigint, payload binary").repartition(tasks, "block")
    met = blocks.mapInArrow(_product, "sig bigint, shared bigint").groupBy("sig").agg(F.sum("shared").alias("shared"))
    left = sets.join(met, "sig", "left").where((F.col("n") - F.col("m") + F.least(F.coalesce("shared", F.lit(0)), F.col("m"))) * 100 >= percent * F.col("n"))
    left = work.write(left.select("sig", "doc_id", "n"), "left")

    wanted = join_checked(texts, left.select("doc_id", "sig"), "doc_id", "inner", 24 * left.count())
    whole = wanted.select("sig", "text").mapInArrow(_whole_rows(k, lower), "id bigint, g array<bigint>").dropDuplicates(["id"])
    # columns and their sizes are written before they meet their entries again, so a column that very many rows have can be split there
    flat = work.write(whole.select("id", F.explode("g").alias("h")), "entries")
    sizes = work.write(flat.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "sizes")
    met = flat.join(sizes, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).getField("h").alias("g"))
    vectors = met.join(left.select(F.col("sig").alias("id"), "n"), "id").withColumn("s", F.size("g").cast("bigint")).where(F.col("s") * 100 >= percent * F.col("n"))
    vectors = work.write(vectors, "vectors")
    work.remove("entries", "sizes")

    # the rarest columns of each row, after those that are its own alone; a size class spans a ratio of 1 / t
    need = F.floor((F.col("n") * percent + 99) / 100)
    lows = vectors.select("id", "n", "s", F.floor(F.log("n") / np.log(100 / percent)).alias("size"), F.posexplode(F.slice("g", F.lit(1), (F.col("s") - need + 1).cast("int"))).alias("p", "h"))
    lows = lows.withColumn("left", F.col("s") - F.col("p")).drop("p")
    hubs = lows.groupBy("h", "size").agg(F.count("*").alias("c"), F.min(F.struct((1 - F.col("s") / F.col("n")).alias("own"), "id", "n", "left")).alias("hub")).where("c > 1")
    stars = work.write(hubs, "stars")
    pairs = lows.join(stars, ["h", "size"]).where((F.col("id") != F.col("hub.id")) & _in_bounds(F.col("n"), F.col("left"), F.col("hub.n"), F.col("hub.left"), percent))
    pairs = pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        one = vectors.select(F.col("id").alias("a"), F.col("g").alias("ga"), F.col("n").alias("na"))
        two = vectors.select(F.col("id").alias("b"), F.col("g").alias("gb"), F.col("n").alias("nb"))
        both = F.size(F.array_intersect("ga", "gb"))
        return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")

    links = work.write(linked(pairs), "edges")
    comp = components(work, links)

    marked = lows.join(comp, "id", "left").select("id", "n", "left", "h", F.coalesce("comp", "id").alias("comp"))
    marked = work.write(marked, "marked")
    main = marked.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1").select("h", F.col("top.comp").alias("main"))
    main = work.write(main, "main")
    odd = marked.join(main, "h").where("comp <> main").select("h", *(F.col(c).alias(f"{c}1") for c in ("id", "n", "left", "comp")))
    rest = odd.join(marked, "h").where((F.col("comp1") != F.col("comp")) & _in_bounds(F.col("n1"), F.col("left1"), F.col("n"), F.col("left"), percent))
    more = work.write(linked(rest.select(F.least("id1", "id").alias("a"), F.greatest("id1", "id").alias("b")).distinct()), "edges")
    if not more.isEmpty():
        comp = components(work, links.union(more))

    classed = work.write(sets.join(comp.select(F.col("id").alias("sig"), "comp"), "sig", "left").select("sig", "doc_id", F.coalesce("comp", "sig").alias("class")), "classed")
    least = classed.groupBy("class").agg(F.min("doc_id").alias("component"))
    return rows, work.write(classed.join(least, "class").select("sig", "class", "component"), "classes")


def jaccard_join(docs: DataFrame, percent: int = 80, k: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of `docs`: one row per row with doc_id, n_shingles and component_id.

    Rows link when 100 * |A & B| >= percent * |A | B| over distinct k-word shingles (words: runs without
    ASCII white space, A-Z lower-cased; fewer than k words are one shingle). Sets are compared by
    64-bit hashes. Rows without words or with a null text have no shingles and link with nothing; a
    row with a null id links with nothing and has a null component. Repeated rows are kept, each with
    its class's smallest id; rows of one id with different texts are classed by their texts. Other columns are not read, whatever
    their names; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "jaccard")
    rows, classes = _classes(work, docs, percent, k, lower, id_col, text_col)
    out = rows.join(classes, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
    )
    out = work.write(out, "out")
    work.drop("out")
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each near-duplicate class: the smallest id's (of its texts one, and of repeated rows one).

    Rows without words, or with a null id, stay; so does each of several texts of one id that are of different
    classes. All columns are kept, whatever their names; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "keep-one")
    rows, classes = _classes(work, docs, id_col=id_col, text_col=text_col, **options)
    named = rows.where("doc_id is not null and n > 0").join(classes.select("sig", "class"), "sig").groupBy("doc_id", "t", "class").agg(F.count("*").alias("times"))
    named = work.write(named, "named")
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    i, t, keep = fresh(docs, "__id", "__t", "__keep")
    odd = named.join(first, "class").withColumn(keep, F.struct("doc_id", "t") == F.col("first")).where((F.col("times") > 1) | ~F.col(keep))
    odd = work.write(odd.select(F.col("doc_id").alias(i), F.col("t").alias(t), keep), "odd")
    work.drop("odd")
    size = 24 * odd.count()
    keyed = docs.withColumns({i: F.col(id_col).cast("bigint"), t: F.xxhash64(F.col(text_col).cast("string"))})
    one = join_checked(keyed, odd, [i, t], "left_anti", size).select(docs.columns)
    again = odd.where(keep)
    if again.isEmpty():
        return one
    return one.union(join_checked(keyed, again, [i, t], "left_semi", size).dropDuplicates([i, t]).select(docs.columns))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
