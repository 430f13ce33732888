"""Near-duplicate books by bit-sliced comparison of minhash sketches, verified exactly.

1. The pages of a book are put together in chunks of ``CHUNK`` pages, never a whole book in one
   task; word runs across chunks come from the chunks' first and last words. Each chunk gives its
   distinct runs of four words, their minima under ``HASHES`` hash functions, and a fingerprint.
   Minima and fingerprints of a book's chunks combine by aggregation.
2. Books with equal texts form one class and are compared once. Classes are told apart by 64 bits of a
   128-bit fingerprint of the words and their order: among 10^9 classes one false merger in all is
   expected with a probability of 0.03.
3. Classes meet in buckets of ``BANDS`` bands of three minima. At a similarity of 0.5 a pair misses
   all buckets with probability (1 - 1/8)^64 = 0.0002, at 0.6 with 2e-7.
4. In each bucket all pairs are compared at once: the low bits of the minima are stored as bit
   planes over the bucket's members; XOR with the planes shifted by d compares all members d apart,
   carry-save adders count the differing bits of all of them, and a block is abandoned as soon as
   all its pairs exceed the radius. Buckets of any size are cut into tiles, so that no task holds one.
5. The pairs within the radius are verified on the runs themselves (40 bits of each run's hash: of a set
   of 10^5 runs one in 10^7 takes another for itself), in segments of bounded size.

Defined cases: null and blank contents are empty pages; the latest row of a page counts; books under
``LEAST_WORDS`` words are in no pair, but have a class of equal texts; null book_ids are left out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import kernel
from leafmill.tables import updated
from leafmill.work import stage

RUN, LEAST_WORDS, SIMILAR = 4, 50, 0.5
CHUNK = 64
HASHES, BANDS = 192, 64
#: Differing bits of the sketches at most: 48 are expected at a similarity of 0.5, with a deviation of 6.9.
RADIUS = 79
#: Members of a tile of a bucket, rows compared at once, and runs in a segment of a large set.
TILE, BLOCK_ROWS, SEGMENT = 2_048, 65_536, 8_192
#: Classes that are broadcast to prune the sets (some 60 bytes each); beyond that the join shuffles.
MOST_BROADCAST = 1_000_000
_SEEDS = (kernel.mix(np.arange(1, HASHES + 1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CHUNKS = "book_id string, chunk long, words int, print long, minima binary, head array<long>, tail array<long>, runs binary, short array<long>"


def _minima(runs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Row i: the minima under each hash function of the runs from begin[i] to begin[i + 1]."""
    x = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), HASHES), np.uint32)
    scratch = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _SEEDS[k], out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, begin)
    return out


def _pack(runs: np.ndarray) -> bytes:
    """Distinct runs as sorted 40-bit numbers: the upper 32 bits of all, then the lower 8."""
    x = np.unique(runs >> np.uint64(24))
    return (x >> np.uint64(8)).astype("<u4").tobytes() + x.astype(np.uint8).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return (np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(data, np.uint8, n, 4 * n)


def _chunk_texts(rows: list) -> str:
    """The current contents of a chunk's pages in order, joined by line feeds."""
    latest: dict = {}
    for r in rows:
        key = (r["at"], r["content"] or "")
        if r["page_num"] not in latest or key > latest[r["page_num"]]:
            latest[r["page_num"]] = key
    return "\n".join(text for _, (_, text) in sorted(latest.items(), key=lambda x: (x[0] is not None, x[0] or 0)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("book_id", pa.string()), ("chunk", pa.int64()), ("words", pa.int32()), ("print", pa.int64()), ("minima", pa.binary()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("runs", pa.binary()), ("short", pa.list_(pa.int64()))])
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            texts = [_chunk_texts(x) for x in part.column(2).to_pylist()]
            out: list[list] = [[], [], [], [], [], [], []]
            for p, q in kernel.blocks(texts):
                words, first, last = kernel.words(texts[p:q])
                signed = words.view(np.int64)
                runs = kernel.shingles(words, RUN)
                # Runs that begin in the last words of a text would go on in the next one.
                stop = np.maximum(last - RUN + 1, first)
                inside = np.zeros(len(runs) + 1, np.int64)
                np.add.at(inside, np.minimum(first, len(runs)), 1)
                np.add.at(inside, np.minimum(stop, len(runs)), -1)
                own = runs[np.cumsum(inside[:-1]) > 0]
                count = stop - first
                at = np.concatenate([[0], np.cumsum(count)])
                full = np.flatnonzero(count > 0)
                minima = np.full((q - p, HASHES), 0xFFFFFFFF, np.uint32)
                if len(full):
                    minima[full] = _minima(own, at[full])
                order = kernel.mix(words + kernel.mix(np.arange(len(words), dtype=np.uint64) - np.repeat(first.astype(np.uint64), last - first)))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(order)])
                prints = kernel.mix(total[last] - total[first]).view(np.int64)
                for i in range(q - p):
                    f, e = first[i], last[i]
                    for column, value in zip(out, (int(e - f), int(prints[i]), minima[i].tobytes(), signed[f : min(e, f + 3)].tolist(), signed[max(f, e - 3) : e].tolist(), _pack(own[at[i] : at[i + 1]]), signed[f:e].tolist() if e - f < LEAST_WORDS else None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(v, schema.field(i + 2).type) for i, v in enumerate(out)]], schema=schema)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs that begin in a chunk's last words and go on in the chunks after it."""
    for batch in batches:
        books, minima, packed = [], [], []
        for book, tail, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            after = [w for head in after for w in head][: RUN - 1]
            words = np.array(tail + after, np.int64).view(np.uint64)
            runs = kernel.shingles(words, RUN)[: len(tail)]
            if len(runs):
                books.append(book)
                minima.append(_minima(runs, np.zeros(1, np.int64))[0].tobytes())
                packed.append(_pack(runs))
        yield pa.RecordBatch.from_arrays([pa.array(books, pa.string()), pa.array(minima, pa.binary()), pa.array(packed, pa.binary())], ["book_id", "minima", "runs"])


def chunks(pages: DataFrame) -> DataFrame:
    """Every chunk's words, minima, runs, and bounds; one shuffle of the contents, by chunk."""
    rows = pages.where("book_id IS NOT NULL").select("book_id", F.expr(f"coalesce(cast(page_num as long) div {CHUNK}, -1)").alias("chunk"), F.struct("page_num", updated().alias("at"), F.col("content").cast("string").alias("content")).alias("page"))
    return rows.groupBy("book_id", "chunk").agg(F.collect_list("page").alias("pages")).mapInArrow(_chunks, _CHUNKS)


def books(chunk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, words, cls, minima) of each book, and all parts of its set: (book_id, runs).

    Only books of several chunks are aggregated; their minima are exploded, so that the shuffle
    combines them on the map side whatever a book's length.
    """
    from pyspark.sql import Window

    filled = chunk.where("words > 0")
    order = Window.partitionBy("book_id").orderBy("chunk").rowsBetween(1, 3)
    ahead = filled.select("book_id", "chunk", "tail", F.collect_list("head").over(order).alias("after")).where("size(after) > 0").select("book_id", "tail", "after")
    across = ahead.mapInArrow(_across, "book_id string, minima binary, runs binary")
    own = lambda seed: F.bit_xor(F.when(F.col("words") > 0, F.xxhash64("print", "chunk", F.lit(seed))))
    per = chunk.groupBy("book_id").agg(F.sum("words").alias("words"), own(1).alias("one"), own(2).alias("two"), F.count("*").alias("parts"))
    per = per.select("book_id", "words", "parts", F.xxhash64("one", "two", "words").alias("cls"))
    pieces = filled.select("book_id", "minima").unionByName(across.select("book_id", "minima"))
    several = pieces.join(per.where("parts > 1").select("book_id"), "book_id")
    byte = "hex(substring(minima, i * 4 + {}, 1))"  # little end first
    number = F.expr(f"posexplode(transform(sequence(0, {HASHES - 1}), i -> conv(concat({', '.join(byte.format(k) for k in (4, 3, 2, 1))}), 16, 10)))")
    low = several.select("book_id", number).select("book_id", "pos", F.col("col").cast("long").alias("v")).groupBy("book_id", "pos").agg(F.min("v").alias("v"))
    merged = low.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).select("book_id", F.expr("unhex(array_join(transform(x, y -> regexp_replace(lpad(hex(y.v), 8, '0'), '(..)(..)(..)(..)', '$4$3$2$1')), ''))").alias("minima"))
    single = filled.select("book_id", "minima").join(per.where("parts = 1").select("book_id"), "book_id")
    whole = single.unionByName(merged).join(per.select("book_id", "words", "cls"), "book_id")
    return whole, filled.select("book_id", "runs").unionByName(across.select("book_id", "runs"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        m = minima.reshape(len(minima), BANDS, -1)
        key = np.zeros(m.shape[:2], np.uint64)
        for i in range(m.shape[2]):
            key = kernel.mix(key + m[:, :, i])
        key = kernel.mix(key + np.arange(BANDS, dtype=np.uint64))
        bits = np.packbits(((kernel.mix(minima + np.arange(HASHES, dtype=np.uint64) * np.uint64(1 << 33)) & np.uint64(1)) == 1), axis=1, bitorder="little")
        sketch = pa.array([r.tobytes() for r in bits], pa.binary())
        cls = batch.column(0)
        for b in range(0, BANDS, 8):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([cls] * 8), pa.array(key[:, b : b + 8].T.ravel().view(np.int64)), pa.concat_arrays([sketch] * 8)], ["cls", "key", "sketch"])


def add_planes(planes: list[int]) -> list[int]:
    """Carry-save addition: for each bit position the number of planes that have it, as bit counters."""
    levels: list[list[int]] = [planes]
    counters = []
    while levels:
        column = levels.pop()
        carries: list[int] = []
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            u = a ^ b
            carries.append((a & b) | (u & c))
            column.append(u ^ c)
        if len(column) == 2:
            a, b = column
            carries.append(a & b)
            column = [a ^ b]
        counters.append(column[0] if column else 0)
        if carries:
            levels.append(carries)
    return counters


def at_most(counters: list[int], radius: int, valid: int) -> int:
    """The positions in ``valid`` whose count is at most ``radius``."""
    over, equal = 0, valid
    for level in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        c = counters[level] if level < len(counters) else 0
        if radius >> level & 1:
            equal &= c
        else:
            over |= equal & c
            equal &= ~c
    return valid & ~over


def near_pairs(sketches: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group, of different sides (0 pairs with all), within the radius.

    ``sketches`` are packed bits; the rows of a group lie together. Rows d apart are compared for
    d = 1, 2, ... while any group is longer; shorter groups drop out of the planes as d grows.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(group))
    d, planes, width = 1, None, 0
    while True:
        begin = np.flatnonzero(np.diff(group[rows], prepend=-1)) if len(rows) else rows
        size = np.diff(np.append(begin, len(rows)))
        if not len(rows) or size.max() <= d:
            break
        keep = np.repeat(size > d, size)
        if planes is None or keep.sum() < 0.7 * width:
            rows = rows[keep]
            width = len(rows)
            bits = np.packbits(np.unpackbits(sketches[rows], axis=1, bitorder="little").T, axis=1, bitorder="little")
            planes = [int.from_bytes(p.tobytes(), "little") for p in bits]
        a, b = rows[:-d], rows[d:]
        valid = (group[a] == group[b]) & ((side[a] != side[b]) | (side[a] == 0))
        lanes = int.from_bytes(np.packbits(valid, bitorder="little").tobytes(), "little")
        totals: list[int] = []
        for k in range(0, len(planes), 64):
            part = add_planes([(p ^ (p >> d)) & lanes for p in planes[k : k + 64]])
            totals = _sum(totals, part)
            lanes = at_most(totals, radius, lanes)
            if not lanes:
                break  # every pair of the block is beyond the radius
        if lanes:
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(lanes.to_bytes(len(rows) // 8 + 1, "little"), np.uint8), bitorder="little"))
            found.append((rows[hit], rows[hit + d]))
        d += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _sum(a: list[int], b: list[int]) -> list[int]:
    """Addition of two vertical counters."""
    out, carry = [], 0
    for i in range(max(len(a), len(b))):
        x, y = a[i] if i < len(a) else 0, b[i] if i < len(b) else 0
        u = x ^ y
        out.append(u ^ carry)
        carry = (x & y) | (u & carry)
    return [*out, carry] if carry else out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, i, j, side, cls, sketch) to candidate pairs; a group is never split."""
    held: list[pa.RecordBatch] = []

    def run(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        ids = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
        group = np.cumsum(np.any(np.diff(ids, axis=0, prepend=ids[:1] - 1) != 0, axis=1)) if n else np.empty(0, np.int64)
        side, cls = table.column(3).to_numpy(), table.column(4).to_numpy()
        sketches = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(n, -1)
        a, b = near_pairs(sketches, group, side)
        x, y = cls[a], cls[b]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def last_start(table: pa.Table) -> int:
        ids = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
        change = np.flatnonzero(np.any(np.diff(ids, axis=0) != 0, axis=1))
        return int(change[-1]) + 1 if len(change) else 0

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            cut = last_start(table)
            if cut:
                yield run(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield run(pa.Table.from_batches(held))


def candidates(reps: DataFrame) -> DataFrame:
    """a, b: the pairs of classes whose sketches lie within the radius in some bucket."""
    bands = stage(reps.select("cls", "minima").mapInArrow(_bands, "cls long, key long, sketch binary"), "bands")
    full = bands.groupBy("key").count().where("count > 1")
    rows = bands.join(full, "key").withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("tiles")).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "cls", "sketch")
    # Tile pairs of a diagonal and of two tiles are groups of their own: (i, i) and (i, j).
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return placed.mapInArrow(_compare, "a long, b long").distinct()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of sets, cut by the upper bits of the runs into segments (cls, fold, segment, runs)."""
    for batch in batches:
        out: list[tuple] = []
        for cls, words, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            fold = max(0, (words // SEGMENT).bit_length())
            if not fold:
                out.append((cls, 0, 0, runs))
                continue
            x = _unpack(runs)
            edges = np.searchsorted(x, np.arange(1 << fold, dtype=np.uint64) << np.uint64(40 - fold))
            for k, part in enumerate(np.split(x, edges[1:])):
                if len(part):
                    out.append((cls, fold, k, (part >> np.uint64(8)).astype("<u4").tobytes() + part.astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["cls", "fold", "segment", "runs"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, segment of fold f, both parts) to the numbers of runs in both and in either."""
    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(("a", "b", "fold", "segment", "x", "y"))}
        both, either = [], []
        for fold, segment, x, y in zip(c["fold"], c["segment"], c["x"], c["y"]):
            sets = []
            for parts in (x, y):
                s = [_unpack(p) for p in parts or ()]
                s = np.unique(np.concatenate(s)) if len(s) > 1 else s[0] if s else np.empty(0, np.uint64)
                if fold:
                    s = s[s >> np.uint64(40 - fold) == segment]
                sets.append(s)
            n = len(np.intersect1d(*sets, assume_unique=True))
            both.append(n)
            either.append(len(sets[0]) + len(sets[1]) - n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b, similarity: the pairs whose sets of runs have at least that Jaccard similarity."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = reps.select("cls", "book_id", "words").join(ends, "cls")
    small = ends.count() <= MOST_BROADCAST
    wanted = F.broadcast(wanted) if small else wanted
    parts = sets.join(wanted, "book_id").select("cls", F.col("words").cast("long"), "runs").mapInArrow(_segments, "cls long, fold int, segment int, runs binary")
    parts = parts.groupBy("cls", "fold", "segment").agg(F.collect_list("runs").alias("runs"))
    folds = reps.select("cls", F.expr(f"cast(case when words < {SEGMENT} then 0 else length(bin(words div {SEGMENT})) end as int)").alias("fold"))
    each = pairs.join(folds.selectExpr("cls as a", "fold as fa"), "a").join(folds.selectExpr("cls as b", "fold as fb"), "b").withColumn("fold", F.greatest("fa", "fb"))
    each = each.withColumn("segment", F.explode(F.expr("sequence(0, cast(shiftleft(1, fold) as int) - 1)")))
    each = each.withColumn("sa", F.expr("shiftright(segment, fold - fa)")).withColumn("sb", F.expr("shiftright(segment, fold - fb)"))
    one, two = (parts.selectExpr(f"cls as {n}", f"segment as s{n}", f"runs as {r}") for n, r in (("a", "x"), ("b", "y")))
    both = each.join(one, ["a", "sa"], "left").join(two, ["b", "sb"], "left").select("a", "b", "fold", "segment", "x", "y")
    sums = both.mapInArrow(_overlap, "a long, b long, both long, either long").groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("either").alias("either"))
    return sums.where(F.col("both") >= F.lit(similar) * F.col("either")).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"))


def short_classes(chunk: DataFrame) -> DataFrame:
    """book_id, cls of the books of fewer than ``LEAST_WORDS`` words, empty ones too: equal words in order are one class.

    A chunk of so few words carries them, so a class doesn't depend on how the text is cut.
    """
    few = chunk.groupBy("book_id").agg(F.sum("words").alias("total")).where(f"total < {LEAST_WORDS}")
    parts = chunk.select("book_id", "chunk", "words", "short").join(few, "book_id")
    whole = parts.groupBy("book_id").agg(F.array_sort(F.collect_list(F.when(F.col("words") > 0, F.struct("chunk", "short")))).alias("parts"))
    return whole.select("book_id", F.flatten("parts.short").alias("text")).select("book_id", F.xxhash64("text", F.size("text")).alias("cls"))


def similar_classes(chunk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: book_id, cls) of all books of enough words, and (links: a, b, similarity) of classes."""
    whole, sets = books(chunk)
    whole = stage(whole.where(f"words >= {LEAST_WORDS}"), "books")
    reps = whole.groupBy("cls").agg(F.min("book_id").alias("book_id")).join(whole.drop("cls"), "book_id")
    reps = stage(reps, "classes")
    pairs = stage(candidates(reps), "pairs")
    return whole.select("book_id", "cls"), stage(verified(pairs, reps, sets), "links")


def similar_books(pages: DataFrame) -> DataFrame:
    """book_id_a, book_id_b: every pair of similar books, copies of one text included."""
    members, links = similar_classes(stage(chunks(pages), "chunks"))
    a, b = members.selectExpr("cls as a", "book_id as one"), members.selectExpr("cls as b", "book_id as two")
    across = links.join(a, "a").join(b, "b").select(F.least("one", "two").alias("book_id_a"), F.greatest("one", "two").alias("book_id_b"))
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("one") < F.col("two"))).select(F.col("one").alias("book_id_a"), F.col("two").alias("book_id_b"))
    return across.unionByName(within)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls, root: the smallest class reachable over the links, by label exchange and pointer jumping.

    Each round is written, so lineage stays short; the number of rounds is about the logarithm of
    the longest chain, as labels jump to their labels' labels.
    """
    both = links.select("a", "b").unionByName(links.selectExpr("b as a", "a as b"))
    state = nodes.select("cls", F.col("cls").alias("root"))
    linked = both.select(F.col("a").alias("cls")).distinct()
    state, rest = stage(state.join(linked, "cls", "left_semi"), "roots"), state.join(linked, "cls", "left_anti")
    while True:
        near = both.join(state.selectExpr("cls as b", "root"), "b").groupBy("a").agg(F.min("root").alias("low")).withColumnRenamed("a", "cls")
        step = state.join(near, "cls").select("cls", F.least("root", "low").alias("next"), F.col("root").alias("before"))
        jump = step.join(step.selectExpr("cls as next", "next as over"), "next", "left").select("cls", F.coalesce(F.least("next", "over"), "next").alias("root"), "before")
        new = stage(jump, "roots")
        if not new.where("root <> before").limit(1).count():
            return new.select("cls", "root").unionByName(rest)
        state = new.select("cls", "root")


def groups(pages: DataFrame) -> DataFrame:
    """book_id, class_id, group_id, links: every book with its class, its group and its class's links.

    Links are between books of enough words. Shorter books have a class of equal texts, no links, and
    as no pair holds them, each a group of its own.
    """
    chunk = stage(chunks(pages), "chunks")
    members, links = similar_classes(chunk)
    roots = components(members.select("cls").distinct(), links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    short = short_classes(chunk).select("book_id", F.col("cls").alias("class_id"), F.xxhash64("cls", "book_id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    linked = members.join(roots, "cls").join(degree, "cls", "left")
    return linked.select("book_id", F.col("cls").alias("class_id"), F.col("root").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")).unionByName(short)
