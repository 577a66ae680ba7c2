"""N-gram Jaccard join by a partitioned universe and the pigeonhole principle.

A document is its set of distinct word 5-shingles (64-bit hashes); documents
with equal sets form a class, and the join works on classes. Sets of sizes
a <= b with Jaccard similarity of 0.8 or more differ in at most
floor((a + b) / 9) shingles.

*Index.* Sizes fall into bands that grow by a quarter, so a pair lies in one
band or two neighbouring ones, and is looked for in the band of its smaller
set. Each band cuts the universe of shingles into segments by hash. A set shows
the hash of its subset in every segment it touches: as index rows in its own
band, as probe rows there and in the band below. In every FLEX-th segment it
also shows the one-deletion neighbourhood of its subset.

*Allocation.* Two sets that differ in at most H shingles agree in all but H of
the segments the larger touches. So a probe must spend H + 1 units: one on a
segment looked up exactly, a second one on a flexible segment looked up with
one deletion on either side. A subset of one shingle has no second unit: what is
left after its deletion would be the empty subset, which is not looked up. Units are spent in the order of their cost, which
is the exact number of index rows they would meet over all data: what nobody
else shows costs nothing, and most sets need no lookup at all. The rare set
that touches too few segments also looks up segments both sets leave empty.

*Verification.* Candidates are compared set against set. First each probe meets
only the most connected set of each of its groups, which joins large groups of
near copies by a star; then all candidates that still lie in different
components meet, so no link between components is lost. Those carry a parity
bitmap: each shingle flips one bit, so two bitmaps differ in at most as many
bits as the sets in shingles, and a pair whose bitmaps differ in more than the
size filter allows cannot link. That is exact: it spares pairs, never links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import FILTER_BITS, bitmap, fresh_prefix, in_bitmap, partitions, written
from ledgerlake.llm.graph import components
from ledgerlake.llm.textkit import flat, mix64, pack_buckets, release, runs, shingle_sets, slices, tidy, unpack

SHINGLE = 5
FLEX = 16
PARITY_WORDS = 8  # a power of two
PARITY = [f"parity{k}" for k in range(PARITY_WORDS)]
SELF, DELETED, EMPTY = 0, 1, 2


def band_starts() -> np.ndarray:
    """First size of each band; the last starts beyond 2**31."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out, np.int64)


STARTS = band_starts()


def segments_of(band: np.ndarray) -> np.ndarray:
    """Segments of a band: enough for any set it serves to touch more of them than
    it may differ in, but for rare accidents."""
    return (np.ceil(0.31 * STARTS[band + 1]) + 2).astype(np.int64)


def units(size, low_next, own: bool):
    """H + 1 for the larger set of a pair, in its own band or in the band below,
    whose sets are smaller than ``low_next``."""
    return (size + size) // 9 + 1 if own else (size + low_next - 1) // 9 + 1


def class_of(h: np.ndarray, d: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest and size of each row's set; equal sets have equal digests."""
    total = np.zeros(rows, np.uint64)
    first = runs(d)
    if len(first):
        total[d[first]] = np.add.reduceat(mix64(h ^ np.uint64(0x2545F4914F6CDD1D)), first)
    n = np.bincount(d, minlength=rows)
    return mix64(total + n.astype(np.uint64)).view(np.int64), n


def signature_rows(h: np.ndarray, d: np.ndarray, cls: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Index and probe rows of sets: ``h`` sorted within ``d``, one row of cls and n
    for each set, all non-empty."""
    parts: list[dict[str, np.ndarray]] = []
    band = np.searchsorted(STARTS, n, "right") - 1
    for own in (True, False):
        space = band if own else band - 1
        use = np.ones(len(n), bool) if own else (band > 0) & (n <= (STARTS[band] - 1) * 5 // 4)
        if not use.any():
            continue
        m = np.where(use, segments_of(np.maximum(space, 0)), 1)
        mine = use[d]
        hh, dd = h[mine], d[mine]
        seg = (((hh >> np.uint64(32)) * m[dd].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        first = runs(dd, seg)
        who, where = dd[first], seg[first]
        salt = mix64((space.astype(np.uint64) << np.uint64(32))[who] + where.astype(np.uint64))
        mixed = mix64(hh)
        total = np.add.reduceat(mixed, first)
        touched = np.bincount(who, minlength=len(n))
        length = np.diff(np.r_[first, len(hh)])
        flexible = (where % FLEX == 0) & (length > 1)
        flex = np.bincount(who[flexible], minlength=len(n))
        need = units(n, STARTS[band], own)
        lacking = use & (touched + flex < need)
        rows = [(mix64(total + salt), who, where, SELF + 16 * flexible)]
        of = np.repeat(np.arange(len(first)), length)
        gone = flexible[of]
        rows.append((mix64((total + salt)[of[gone]] - mixed[gone]), who[of[gone]], where[of[gone]], DELETED + 16))
        show = use if own else lacking
        if show.any():
            cells = np.repeat(np.flatnonzero(show), m[show])
            place = np.arange(len(cells)) - np.repeat(np.cumsum(m[show]) - m[show], m[show])
            start = np.zeros(len(n), np.int64)
            start[show] = np.cumsum(m[show]) - m[show]
            empty = np.ones(len(cells), bool)
            seen = show[who]
            empty[start[who[seen]] + where[seen]] = False
            cells, place = cells[empty], place[empty]
            rows.append((mix64(mix64((space.astype(np.uint64) << np.uint64(32))[cells] + place.astype(np.uint64)) + np.uint64(1)), cells, place, EMPTY))
        for sig, w, s, kind in rows:
            parts.append({"sig": sig, "cls": cls[w], "n": n[w].astype(np.int32), "seg": s.astype(np.int32),
                          "what": (kind + 4 * own + 8 * lacking[w]).astype(np.uint8),
                          "units": (touched + flex)[w].astype(np.int32)})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def parity_bits(h: np.ndarray, d: np.ndarray, rows: int) -> np.ndarray:
    """PARITY_WORDS longs a set: the bits that its shingles hit an odd number of
    times. ``h`` is sorted within ``d``."""
    out = np.zeros((rows, PARITY_WORDS), np.uint64)
    high = PARITY_WORDS.bit_length() - 1
    word = (h >> np.uint64(64 - high)).astype(np.int64)
    bit = np.uint64(1) << ((h >> np.uint64(58 - high)) & np.uint64(63))
    first = runs(d, word)
    if len(first):
        out[d[first], word[first]] = np.bitwise_xor.reduceat(bit, first)
    return out.view(np.int64)


def sets_of(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """``extra`` columns with cls and n_shingles; documents without words have n_shingles 0."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra) + ", cls long, n_shingles long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = flat(b.columns[-1])
            for i, j in slices(offs):
                h, d = shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], SHINGLE)
                cls, n = class_of(h, d, j - i)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(cls), pa.array(n)],
                                                 names=[*extra, "cls", "n_shingles"])

    return docs.select(*extra, F.col("text").alias("_text_")).mapInArrow(run, schema)


def _signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows by signature bucket, a class once per batch."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[dict]) -> pa.RecordBatch:
            cols = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            ids, blobs = pack_buckets((cols["sig"] >> np.uint64(40)).astype(np.int64) % buckets, cols, buckets)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        parts, size = [], 0
        for b in batches:
            buf, offs = flat(b.column(0))
            for i, j in slices(offs):
                h, d = shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], SHINGLE)
                cls, n = class_of(h, d, j - i)
                _, at = np.unique(cls, return_index=True)
                at = np.sort(at[n[at] > 0])
                if not len(at):
                    continue
                new = np.full(j - i, -1)
                new[at] = np.arange(len(at))
                keep = new[d] >= 0
                parts.append(signature_rows(h[keep], new[d[keep]], cls[at], n[at]))
                size += len(parts[-1]["sig"])
                if size > 800_000:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)

    return docs.select("text").mapInArrow(run, "bucket int, blob binary")


def _shared(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of the groups in which some probe meets another class's index row, with
    the number of index rows each would meet: c0 exactly, c1 by one deletion."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [unpack(x.as_py()) for b in batches for x in b.column(0)]
        if not tables:
            return
        t = pa.concat_tables(tables)
        del tables
        sig = t.column("sig").to_numpy()
        o = np.argsort(sig)
        first = runs(sig[o])
        many = np.diff(np.r_[first, len(o)]) > 1
        o = np.sort(o[np.repeat(many, np.diff(np.r_[first, len(o)]))])
        t = t.take(pa.array(o))  # the few that meet another row; the rest is let go
        sig = sig[o]
        release()
        o = np.argsort(sig)
        sig, cls, what = sig[o], t.column("cls").to_numpy()[o], t.column("what").to_numpy()[o]
        p = np.lexsort((what, cls, sig))
        keep = p[runs(sig[p], cls[p], what[p])]  # copies of a class met in several batches count once
        o, sig, cls, what = o[keep], sig[keep], cls[keep], what[keep]
        if not len(o):
            return
        first = runs(sig)
        size = np.diff(np.r_[first, len(o)])
        own, kind, lacking, flexible = what & 4 > 0, what & 3, what & 8 > 0, what & 16 > 0
        def per(flags: np.ndarray) -> np.ndarray:
            return np.repeat(np.add.reduceat(flags.astype(np.int64), first), size)
        index = per(own & (kind == SELF))
        deleted = per(own & (kind == DELETED))
        hollow = per(own & (kind == EMPTY))
        c0 = np.where(kind == SELF, index - own, np.where((kind == EMPTY) & lacking, hollow - own, 0))
        c1 = np.where(kind == SELF, deleted, np.where(kind == DELETED, index, 0))
        use = np.repeat(np.maximum.reduceat(c0 + c1, first) > 0, size)
        use &= (kind != EMPTY) | (per((kind == EMPTY) & lacking) > 0)
        o = o[use]
        rows = t.take(pa.array(o))
        yield pa.RecordBatch.from_arrays([
            pa.array(sig[use].view(np.int64)), pa.array(cls[use]), rows.column("n").combine_chunks(), rows.column("seg").combine_chunks(),
            rows.column("units").combine_chunks(), pa.array(own[use]), pa.array(kind[use].astype(np.int32)), pa.array(flexible[use]), pa.array(c0[use]), pa.array(c1[use])],
            names=["sig", "cls", "n", "seg", "units", "own", "kind", "flexible", "c0", "c1"])
        del t, rows

    return packed.repartitionById(buckets, F.col("bucket")).select("blob").mapInArrow(
        run, "sig long, cls long, n int, seg int, units int, own boolean, kind int, flexible boolean, c0 long, c1 long")


def _need(n: Column, own: Column) -> Column:
    """``units`` as a column."""
    edges = F.array(*[F.lit(int(x)) for x in STARTS[:-1]])
    low = F.array_max(F.filter(edges, lambda x: x <= n))
    return F.when(own, F.floor(2 * n / 9)).otherwise(F.floor((n + low - 1) / 9)) + 1


def _allocated(shared: DataFrame) -> DataFrame:
    """(cls, own, seg, level) of the lookups to make: level 1 includes one deletion."""
    cost = shared.groupBy("cls", "own", "seg").agg(F.max("n").alias("n"), F.max("units").alias("units"), F.sum("c0").alias("c0"),
                                                   F.sum("c1").alias("c1"), F.max((F.col("kind") == EMPTY).cast("int")).alias("hollow"), F.max("flexible").alias("flexible"))
    exact = F.when(F.col("c0") > 0, F.struct(F.lit(0).alias("level"), F.col("c0").alias("cost")))
    loose = F.when(F.col("flexible") & (F.col("c0") + F.col("c1") > 0), F.struct(F.lit(1).alias("level"), F.greatest("c0", "c1").alias("cost")))
    items = cost.select("cls", "own", "seg", "n", "units", "hollow", F.inline(F.array_compact(F.array(exact, loose))))
    mine = Window.partitionBy("cls", "own")
    items = items.withColumn("free", F.col("units") - F.sum(1 - F.col("hollow")).over(mine))
    items = items.withColumn("place", F.row_number().over(mine.orderBy("hollow", "cost", "seg", "level")))
    return (items.where(F.col("place") <= _need(F.col("n"), F.col("own")) - F.col("free"))
                 .groupBy("cls", "own", "seg").agg(F.max("level").alias("level")))


def _fits(small: str, large: str) -> Column:
    """The size filter; of equal sizes the smaller class is the smaller set."""
    a, b = F.col(f"{small}.n"), F.col(f"{large}.n")
    return (a * 5 >= b * 4) & ((a < b) | ((a == b) & (F.col(f"{small}.cls") < F.col(f"{large}.cls"))))


def _close(x: str, y: str, percent: int) -> Column:
    """The parity filter: with c common shingles of a + b, the link
    100 * c >= percent * (a + b - c) leaves at most
    (a + b) * (100 - percent) / (100 + percent) shingles that differ."""
    apart = sum((F.bit_count(F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))) for k in PARITY), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def _meets() -> Column:
    """An index row that a probe's lookup returns."""
    pk, ik, level = F.col("p.kind"), F.col("i.kind"), F.col("p.level")
    return (((pk == SELF) & (ik == SELF)) | ((pk == SELF) & (level == 1) & (ik == DELETED))
            | ((pk == DELETED) & (ik == SELF)) | ((pk == EMPTY) & (ik == EMPTY)))


def _chosen_sets(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cls, set, parity) of the candidate classes, a set as sorted 64-bit hashes.

    A bitmap of fixed size (2**24 bits) of the candidates' hashes travels to all
    tasks and spares most other sets the shuffle; the join decides.
    """
    spark = docs.sparkSession
    bit = F.col("cls").bitwiseAND((1 << FILTER_BITS) - 1)
    shared = spark.sparkContext.broadcast(bitmap(candidates.select(bit.alias("bit")), "bit"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = flat(b.column(0))
            for i, j in slices(offs):
                h, d = shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], SHINGLE)
                cls, n = class_of(h, d, j - i)
                take = np.flatnonzero(in_bitmap(shared.value, cls.view(np.uint64)) & (n > 0))
                _, once = np.unique(cls[take], return_index=True)
                take = take[np.sort(once)]
                start = np.searchsorted(d, take)
                new = np.full(j - i, -1)
                new[take] = np.arange(len(take))
                keep = new[d] >= 0
                bits = parity_bits(h[keep], new[d[keep]], len(take))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cls[take]), pa.array([h[a:a + k].tobytes() for a, k in zip(start, n[take], strict=True)], pa.binary()),
                    *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], names=["cls", "set", *PARITY])

    schema = "cls long, set binary, " + ", ".join(f"{x} long" for x in PARITY)
    some = docs.select("text").mapInArrow(run, schema).dropDuplicates(["cls"])
    return some.join(candidates, "cls", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * common >= percent * union."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def class_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(cls, root) of the classes that are linked with another one."""
    if percent < 80:
        raise ValueError("the bands serve similarities of 0.8 or more")
    n = partitions(docs.sparkSession)
    shared = written(_shared(_signatures(docs, n), n), "join-shared")
    probes = shared.join(_allocated(shared), ["cls", "own", "seg"]).where("kind != 1 OR level = 1")
    probes = written(probes.where("kind != 2 OR c0 > 0").select("sig", "cls", "n", "kind", "level"), "join-probes")
    met = probes.select("sig").distinct()
    index = shared.where("own").join(met, "sig", "left_semi").select("sig", "cls", "n", "kind")
    # The most connected index set of a group: the one whose groups are largest.
    weight = shared.where("own AND kind = 0").groupBy("cls").agg(F.sum("c0").alias("weight"))
    index = written(index.join(weight, "cls", "left").withColumn("weight", F.coalesce("weight", F.lit(0))), "join-index")
    hub = index.groupBy("sig").agg(F.max(F.struct("weight", "cls", "n", "kind")).alias("h")).select("sig", "h.*")
    star = (probes.alias("p").join(hub.alias("i"), "sig").where(_meets() & (_fits("i", "p") | _fits("p", "i")))
                  .select(F.least("p.cls", "i.cls").alias("a"), F.greatest("p.cls", "i.cls").alias("b")).distinct())
    candidates = probes.select("cls").union(index.select("cls")).distinct()
    sets = written(_chosen_sets(docs, candidates), "join-sets")
    linked = written(_verified(star, sets, percent), "join-links")
    roots = written(components(linked, "a", "b").select(F.col("node").alias("cls"), "root"), "join-roots")

    marks = sets.select("cls", *PARITY).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(marks, "cls")

    # What is left: probes and index rows of groups that hold several components.
    # A group's largest component meets only the rest of its group.
    p, i = rooted(probes), rooted(index)
    every = p.select("sig", "cls", "root").union(i.select("sig", "cls", "root")).distinct()
    sizes = every.groupBy("sig", "root").agg(F.count("*").alias("k")).groupBy("sig").agg(
        F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"))
    mixed = sizes.where("roots > 1").select("sig", F.col("top.root").alias("main"))
    p, i = p.join(mixed, "sig"), i.join(mixed, "sig")
    apart = _meets() & _fits("i", "p") & (F.col("p.root") != F.col("i.root")) & _close("i", "p", percent)
    rest = (p.where("root != main").alias("p").join(i.alias("i"), "sig").where(apart).select(F.col("i.cls").alias("a"), F.col("p.cls").alias("b"))
            .union(p.where("root = main").alias("p").join(i.where("root != main").alias("i"), "sig").where(apart)
                    .select(F.col("i.cls").alias("a"), F.col("p.cls").alias("b")))).distinct()
    more = _verified(rest, sets, percent)
    return components(linked.union(more), "a", "b").select(F.col("node").alias("cls"), "root")


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable) of every document.

    A null or empty text, or one without words, has n_shingles 0 and is linked
    with nothing: its component is its own id. Shorter texts than five words are
    one shingle. Null ids are allowed; they take the least id of their component
    if it has one. Repeated rows keep a row each. Other columns are not read.
    """
    rows = written(sets_of(docs.select("doc_id", "text"), ["doc_id"]), "join-classes")
    known = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    roots = class_components(docs, percent)
    known = known.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = known.join(least, "root").select("cls", F.col("component_id").alias("_c"))
    return rows.join(of_class, "cls", "left").select("doc_id", "n_shingles", F.when(
        F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"))


def _where_bitmap(docs: DataFrame, hashed: str, bits, inside: bool) -> DataFrame:
    """Rows whose ``hashed`` (a long) is, or is not, in the bitmap."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = in_bitmap(bits.value, b.column(b.num_columns - 1).to_numpy().view(np.uint64))
            yield b.filter(pa.array(got == inside))

    return docs.select(*[c for c in docs.columns if c != hashed], hashed).mapInArrow(
        run, T.StructType([docs.schema[c] for c in docs.columns if c != hashed] + [T.StructField(hashed, T.LongType())]))


def keep_one_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id (a
    null id comes last), of rows that share it the one with the least text hash,
    once. Documents without words are in no group and all stay.

    Texts that are in no group stay where they are: a bitmap of fixed size tells
    them apart, and only the others are joined with the decisions.
    """
    tag = fresh_prefix(docs.columns, "join_")
    th, row = tag + "th", tag + "row"
    keyed = docs.withColumn(th, F.xxhash64("text")).withColumn(row, F.xxhash64("doc_id", th))
    sets = written(sets_of(keyed.select(F.col("doc_id").cast("long").alias("id"), F.col(th).alias("th"), F.col(row).alias("row"), "text"),
                           ["id", "th", "row"]).where("n_shingles > 0"), "join-classes")
    roots = class_components(docs, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th"))
    classes = sets.groupBy("cls").agg(first.alias("o"), F.count("*").alias("k")).join(roots, "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    groups = classes.groupBy("root").agg(F.min("o").alias("o"), F.sum("k").alias("k")).where("k > 1")
    of_class = classes.select("cls", "root").join(groups, "root").select("cls", "o")
    members = written(sets.join(of_class, "cls").groupBy("id", "th", "row").agg(
        F.max(F.col("id").eqNullSafe(F.col("o.id")) & (F.col("th") == F.col("o.th"))).alias("keep")), "join-members")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(
        members.select(F.col("row").bitwiseAND((1 << FILTER_BITS) - 1).alias("bit")), "bit"))
    some = _where_bitmap(keyed, row, bits, True)
    m = members.select(F.col("id").alias(tag + "id"), F.col("th").alias(tag + "t"), F.col("row").alias(row), F.col("keep").alias(tag + "keep"))
    found = some.join(m, [row], "left")
    one = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))
    found = found.withColumn(tag + "n", F.when(F.col(tag + "keep").isNotNull(), one).otherwise(F.lit(1)))
    kept = found.where(F.coalesce(tag + "keep", F.lit(True)) & (F.col(tag + "n") == 1))
    return _where_bitmap(keyed, row, bits, False).select(*docs.columns).unionByName(kept.select(*docs.columns))
