"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct shingles (n words, A-Z lower-cased; fewer words: the whole
sequence; none: empty). Two documents link when ``percent`` x union <= 100 x intersection.

1. A pass counts shingles in a sketch of fixed size (``SKETCH`` counters) and small set sizes. The
   sketch only orders shingles, rare ones first; any order gives the same result.
2. Sets up to the boundary give a key for every subset of the sizes that a link needs; larger sets
   (and small ones that a larger set could link with) give their rarest shingles, of which linked
   sets share at least one. The boundary is the cheapest by the counted sizes.
3. Equal sets are one vertex. Of each list of keys, members pair with the list's smallest and
   largest vertex first. Pairs whose bitmaps show too many elements of one set alone are no links
   (an exact bound); the others are verified on whole texts and give components.
4. Lists of up to three members are complete then. Longer ones whose members are in several
   components pair these members with pivots outside their component, which a hash chooses for each
   key and round: a near copy meets other pivots on each of its lists, in pairs linear in the lists.
5. Lists that are still in several components pair their members across components, where bitmaps
   let a link seem possible, and verification decides. Pairs inside a component are not needed for
   it, and no link between components is lost, however many rounds came before.

Result: one row per input row, its component is the smallest id reachable by links. Null and empty
texts have 0 shingles and link with nothing. A null id never is the smallest; a row with a null id
that links with nothing has a null component. Repeated rows are in one component. An empty table
gives no rows. Sets are told apart by 128-bit hashes; of two sets the shingles are compared by 64-bit ones.
A row with a null id links like others.
"""

from __future__ import annotations

import itertools
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, components, prepare, table, written

SKETCH, CHUNKS, SMALLEST_LARGE, MOST_SUBSETS = 1 << 20, 32, 24, 5000
#: Rounds of pivots, and pivots of each list in a round. They only spare pairs of the last step.
ROUNDS, PIVOTS = 2, 2
MOST_SEEN = 500_000
#: Bitmaps have 8 bits an element up to this size, beyond it at least two.
FINE_BITS = 4096
#: Characters of texts whose words a task holds at once; a longer text comes alone.
CHARS = 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ROWS = "doc_id string, carried binary, vertex long, second long, n int, keys array<long>, subsets array<int>, bits array<long>"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters neighbours."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about CHARS characters of text."""
    for frame in frames:
        upto = np.cumsum([len(t) for t in frame["text"]], dtype=np.int64) // CHARS
        for _, part in frame.groupby(upto, sort=False):
            yield part


class Hashes(dict):
    """Hashes of words; hits cost a dictionary lookup."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sets of hashed shingles."""

    def __init__(self, n: int):
        self.n, self.known = n, Hashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        words = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        h = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum()))
        ends = np.cumsum(counts)
        many = self._rolled(h, self.n) if len(h) >= self.n else h[:0]
        out = []
        for count, end in zip(counts.tolist(), ends.tolist()):
            if count >= self.n:
                out.append(np.unique(many[end - count : end - self.n + 1]))
            else:  # the whole sequence, as one; none of no words
                out.append(self._rolled(h[end - count : end], count) if count else h[:0])
        return out

    @staticmethod
    def _rolled(h: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n successive words."""
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return mixed(out)

    def of(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]


def bitmap(values: np.ndarray) -> list[int]:
    """Hashed elements of a set as bits of 64-bit numbers: 8 bits an element for sets of up to FINE_BITS / 8,
    at least two for others; a power of two in all, so sizes of sets that can link differ by one step at most.

    A bit that only one of two sets has stands for an element that only that set has, which bounds
    their intersection from above.
    """
    power = lambda bits: max(64, 1 << max(1, bits - 1).bit_length())
    size = max(min(power(8 * len(values)), FINE_BITS), power(2 * len(values)))
    bits = np.zeros(size, dtype=np.uint8)
    bits[(values & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def needed(a: int, b: int, percent: int) -> int:
    """Smallest intersection of sets of a and b elements that links them."""
    return -(-percent * (a + b) // (100 + percent))


def partners(size: int, percent: int) -> range:
    """Sizes that a set of ``size`` can link with."""
    return range(-(-percent * size // 100), 100 * size // percent + 1)


def prefix(size: int, percent: int) -> int:
    return size - (-(-percent * size // 100)) + 1


def subset_sizes(size: int, percent: int) -> list[int]:
    return sorted({c for b in partners(size, percent) if (c := needed(size, b, percent)) <= min(size, b)})


def boundary(histogram: dict[int, int], percent: int) -> int:
    """Largest size whose sets are joined by subsets: the cheapest by counted sizes.

    A subset costs one key. A shingle on an inverted list costs one key and, for what it brings up,
    a verification in proportion to the size. Sets near the boundary are on both sides.
    """
    subsets = {s: sum(math.comb(s, c) for c in subset_sizes(s, percent)) for s in range(1, SMALLEST_LARGE)}
    lists = {s: prefix(s, percent) * (1 + s / 8) for s in range(1, SMALLEST_LARGE)}

    def cost(x: int) -> float:
        low = min(partners(x + 1, percent))
        return sum(n * ((subsets[s] if s <= x else 0) + (lists[s] if s > x or s >= low else 0)) for s, n in histogram.items() if 0 < s < SMALLEST_LARGE)

    usable = [x for x in range(SMALLEST_LARGE) if x == 0 or max(subsets[s] for s in range(1, x + 1)) <= MOST_SUBSETS]
    return min(usable, key=cost)


def subset_keys(values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(key, subset size)."""
    found = []
    for c in subset_sizes(len(values), percent):
        for chosen in itertools.combinations(values.tolist(), c):
            found.append((xxhash.xxh64_intdigest(np.array(chosen, dtype=np.uint64).tobytes(), c) >> 1, c))
    return found


def counted(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """The sketch and the histogram of small sizes. Sketches are summed in two steps of bounded groups."""

    def count(frames):
        shingler, sketch, sizes = Shingler(n), np.zeros(SKETCH, dtype=np.int64), np.zeros(SMALLEST_LARGE, dtype=np.int64)
        for frame in bounded(frames):
            sets = shingler.sets(frame["text"].tolist())
            if sets:
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                sizes += np.bincount([min(len(s), SMALLEST_LARGE) for s in sets], minlength=SMALLEST_LARGE + 1)[:SMALLEST_LARGE]
        step, salt = SKETCH // CHUNKS, TaskContext.get().partitionId() % 64
        z = zstandard.ZstdCompressor(level=1)
        chunks = [z.compress(sketch[i * step : (i + 1) * step].tobytes()) for i in range(CHUNKS)] + [z.compress(sizes.tobytes())]
        yield pd.DataFrame({"chunk": range(CHUNKS + 1), "salt": salt, "counts": chunks})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(c), dtype=np.int64) for c in frame["counts"])
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "salt": [0], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    schema = "chunk int, salt int, counts binary"
    parts = docs.select("text").mapInPandas(count, schema).groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    got = {r["chunk"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), dtype=np.int64) for r in parts}
    if not got:
        return np.zeros(SKETCH, dtype=np.uint32), {}
    sketch = np.concatenate([got[i] for i in range(CHUNKS)])
    return np.minimum(sketch, 2**32 - 1).astype(np.uint32), {s: int(v) for s, v in enumerate(got[CHUNKS]) if v}


def signature(values: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), len(values) + (seed << 48)) - (1 << 63)


def signed(docs: DataFrame, n: int, percent: int, sketch: np.ndarray, small: int) -> DataFrame:
    """ROWS: of every document its vertex; keys with the first document of a vertex in each task.

    A task remembers vertices in bounded memory; one that comes again later gives its keys again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    both = min(partners(small + 1, percent))

    def run(frames):
        shingler, seen = Shingler(n), set()
        for frame in bounded(frames):
            out = []
            for doc_id, carried, values in zip(frame["doc_id"], frame["carried"], shingler.sets(frame["text"].tolist())):
                vertex, second = signature(values), signature(values, 1)
                keys: list[tuple[int, int]] = []
                if (vertex, second) not in seen and len(values):
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen.add((vertex, second))
                    if len(values) <= small:
                        keys += subset_keys(values, percent)
                    if len(values) > small or len(values) >= both:
                        order = np.lexsort((values, shared.value[(values >> np.uint64(44)).astype(np.int64)]))[: prefix(len(values), percent)]
                        keys += [(k, 0) for k in (values[order] >> np.uint64(1)).tolist()]
                out.append((doc_id, carried, vertex, second, len(values), [k for k, _ in keys], [c for _, c in keys], bitmap(values) if keys else None))
            yield pd.DataFrame(out, columns=["doc_id", "carried", "vertex", "second", "n", "keys", "subsets", "bits"])

    return docs.mapInPandas(run, ROWS)


def told_apart(signs: DataFrame) -> DataFrame:
    """Vertices by both 64-bit hashes of a set, so unequal sets of one hash are two vertices.

    Hashes of more than one set are looked for over all rows; there are hardly ever any.
    """
    shared = signs.groupBy("vertex").agg(F.min("second").alias("l"), F.max("second").alias("h")).where("l <> h").select("vertex", F.lit(True).alias("clash"))
    shared = written(shared, "clashes")
    if shared.isEmpty():
        return signs
    return signs.join(shared, "vertex", "left").withColumn("vertex", F.when("clash", F.xxhash64("vertex", "second")).otherwise(F.col("vertex"))).drop("clash")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of vertices those that link. ``texts``: vertex, text."""
    left = texts.select(F.col("vertex").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("vertex").alias("b"), F.col("text").alias("b_text"))

    def run(frames):
        shingler, known = Shingler(n), OrderedDict()

        def values(vertex: int, text: str) -> np.ndarray:
            if vertex in known:
                known.move_to_end(vertex)
                return known[vertex]
            known[vertex] = shingler.of(text)
            if len(known) > 256:
                known.popitem(last=False)
            return known[vertex]

        for frame in frames:
            links = []
            for a, b, s, t in zip(frame["a"], frame["b"], frame["a_text"], frame["b_text"]):
                x, y = values(a, s), values(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[links, ["a", "b"]]

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _fits(a: str, b: str, percent: int):
    """Whether two members of a list can link: by size, and a subset must be as large as needed."""
    x, y = F.col(f"{a}_n").cast("long"), F.col(f"{b}_n").cast("long")
    size = (F.lit(percent) * F.greatest(x, y) <= F.lit(100) * F.least(x, y))
    return size & ((F.col("subset") == 0) | (F.col("subset") * (100 + percent) >= percent * (x + y)))


def _possible(percent: int):
    """Whether sets a and b can link by what their bitmaps say (a_n, a_bits, b_n, b_bits)."""
    # of two sizes the longer bitmap is folded to the shorter one's length
    fold = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, cast(size({x}) / 2 as int)), slice({x}, cast(size({x}) / 2 as int) + 1, cast(size({x}) / 2 as int)), (p, q) -> p | q), {x})"
    alone = lambda x, y: f"aggregate(zip_with({fold(x, y)}, {fold(y, x)}, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)"
    need = f"({percent} * (cast(a_n as long) + b_n))"
    return F.expr(f"({100 + percent} * (a_n - {alone('a_bits', 'b_bits')}) >= {need}) and ({100 + percent} * (b_n - {alone('b_bits', 'a_bits')}) >= {need})")


def _owned(signs: DataFrame, rows: DataFrame, pairs: DataFrame, words: int, name: str) -> DataFrame:
    """vertex, text of the vertices in pairs, of one document each: by its id, or where only rows without
    an id have that set, by the set of these rows."""
    ends = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
    owners = signs.join(ends, "vertex", "left_semi").groupBy("vertex", "second").agg(F.min("doc_id").alias("doc_id"))
    named = rows.join(owners.where("doc_id is not null"), "doc_id").select("vertex", "second", "text")
    return written(_texts(named, words).union(_texts(rows.where("doc_id is null").select("text"), words, owners.where("doc_id is null"))), name)


def _open(lists: DataFrame, label: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
    """Members of lists with their components; of lists that hold several components key, subset and pivots."""
    here = lists.join(label.withColumnRenamed("id", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    chosen = [F.min(F.struct(F.xxhash64("vertex", "key", F.lit(PIVOTS * r + i)).alias("h"), "vertex", "n", "component")) for i in range(PIVOTS)]
    heads = here.groupBy("key", "subset").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.array(*chosen).alias("pivots"))
    return here, heads.where("l <> h").select("key", "subset", "pivots")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what ``label`` has joined and of more links."""
    return components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80, carry: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, group_id, carried: one row per input row.

    ``group_id`` is the same for all rows of a component (rows without shingles have none); ``carried`` is
    what ``carry`` (binary) is on the row, or null.
    """
    prepare(docs.sparkSession)
    own = F.lit(None) if carry is None else carry
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), own.cast("binary").alias("carried"))
    sketch, histogram = counted(rows, words)
    named = rows.withColumn("doc_id", as_text(F.col("doc_id")))
    signs = signed(named, words, percent, sketch, boundary(histogram, percent)).withColumn("doc_id", F.col("doc_id").cast("long"))
    signs, rows = told_apart(written(signs, "signatures")), rows.drop("carried")
    marks = signs.where("bits is not null").select("vertex", "n", "bits").dropDuplicates(["vertex"])
    marked = lambda p: marks.toDF(p, f"{p}_n", f"{p}_bits")

    keyed = signs.where("size(keys) > 0").select("vertex", "n", F.explode(F.arrays_zip("keys", "subsets")).alias("k")).select("vertex", "n", F.col("k.keys").alias("key"), F.col("k.subsets").alias("subset"))
    ends = keyed.groupBy("key", "subset").agg(F.min(F.struct("vertex", "n")).alias("lo"), F.max(F.struct("vertex", "n")).alias("hi"), F.count("*").alias("members")).where("lo.vertex <> hi.vertex")
    lists = written(keyed.join(ends, ["key", "subset"]).select("key", "subset", "vertex", "n", "members", F.col("lo.vertex").alias("lo"), F.col("lo.n").alias("lo_n"), F.col("hi.vertex").alias("hi"), F.col("hi.n").alias("hi_n")), "lists")

    # each member with the smallest and the largest of its list
    v = lists.select("subset", "vertex", F.col("n").alias("v_n"), F.explode(F.array(F.struct(F.col("lo").alias("w"), F.col("lo_n").alias("w_n")), F.struct(F.col("hi").alias("w"), F.col("hi_n").alias("w_n")))).alias("e"))
    v = v.select("subset", "vertex", "v_n", F.col("e.w").alias("w"), F.col("e.w_n").alias("w_n")).where(F.col("vertex") != F.col("w")).where(_fits("v", "w", percent))
    star = v.select(F.least("vertex", "w").alias("a"), F.greatest("vertex", "w").alias("b")).distinct()
    first = written(star.join(marked("a"), "a").join(marked("b"), "b").where(_possible(percent)).select("a", "b"), "pairs")
    links = written(verified(first, _owned(signs, rows, first, words, "texts"), words, percent), "links")
    label = components(links)

    # pivots for what longer lists hold in several components
    longer = written(lists.where("members > 3").select("key", "subset", "vertex", "n").distinct(), "longer")
    fine = written(marks.join(longer.select("vertex").distinct(), "vertex", "left_semi"), "bitmaps")
    marked = lambda p: fine.toDF(p, f"{p}_n", f"{p}_bits")
    done = first
    for r in range(ROUNDS):
        here, heads = _open(longer, label, r)
        e = here.join(heads, ["key", "subset"]).select("subset", "vertex", F.col("n").alias("v_n"), "component", F.explode("pivots").alias("p"))
        e = e.where("component <> p.component").select("subset", "vertex", "v_n", F.col("p.vertex").alias("w"), F.col("p.n").alias("w_n")).where(_fits("v", "w", percent))
        e = e.select(F.least("vertex", "w").alias("a"), F.greatest("vertex", "w").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        pairs = written(e.join(marked("a"), "a").join(marked("b"), "b").where(_possible(percent)).select("a", "b"), "pairs")
        if pairs.isEmpty():
            break
        label, done = _merged(label, verified(pairs, _owned(signs, rows, pairs, words, "texts"), words, percent)), done.union(pairs)

    # what lists still hold in several components
    here, heads = _open(longer, label, ROUNDS)
    still = written(here.join(heads.select("key", "subset"), ["key", "subset"]).join(fine.select("vertex", "bits"), "vertex"), "open")
    side = lambda p: still.select("key", "subset", F.col("vertex").alias(p), F.col("n").alias(f"{p}_n"), F.col("component").alias(f"{p}_c"), F.col("bits").alias(f"{p}_bits"))
    across = F.expr("a < b and a_c <> b_c") & _fits("a", "b", percent) & _possible(percent)
    more = written(side("a").join(side("b"), ["key", "subset"]).where(across).select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        label = _merged(label, verified(more, _owned(signs, rows, more, words, "texts"), words, percent))

    vertices = signs.where("n > 0").groupBy("vertex").agg(F.min("doc_id").alias("least")).join(label.withColumnRenamed("id", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    least = vertices.groupBy("component").agg(F.min("least").alias("component_id"))
    found = vertices.join(least, "component").select("vertex", "component_id", F.col("component").alias("group_id"))
    joined = signs.select("doc_id", "carried", "vertex", "n").join(found, "vertex", "left")
    some = F.col("n") > 0
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("group_id")).alias("group_id"), "carried")


def _texts(rows: DataFrame, words: int, wanted: DataFrame | None = None) -> DataFrame:
    """vertex, text: one of each. Of ``rows`` (vertex, second, text) those whose text has that set (an id may
    have several texts); or of texts alone, those of ``wanted`` sets."""

    def check(frames):
        shingler = Shingler(words)
        for frame in bounded(frames):
            same = [signature(x, 1) == v for x, v in zip(shingler.sets(frame["text"].tolist()), frame["second"])]
            yield frame.loc[same, ["vertex", "text"]]

    def name(frames):
        shingler = Shingler(words)
        for frame in bounded(frames):
            yield frame.assign(second=[signature(x, 1) for x in shingler.sets(frame["text"].tolist())], first=[signature(x) for x in shingler.sets(frame["text"].tolist())])

    if wanted is None:
        return rows.mapInPandas(check, "vertex long, text string").dropDuplicates(["vertex"])
    return rows.mapInPandas(name, "text string, second long, first long").join(wanted, "second").where((F.col("first") == F.col("vertex")) | (F.xxhash64("first", "second") == F.col("vertex"))).select("vertex", "text").dropDuplicates(["vertex"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=4, percent=85).drop("group_id", "carried")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
