"""Operator 8, near duplicates by Order MinHash: k-mers of words that keep their order in the text.

A k-mer is ``K`` words in a row, labelled with its occurrence. For each of ``TABLES`` hash functions a
text's sketch holds the ``ELL`` k-mers of least hash in the order of the text, so that two texts agree
in a table if they share these k-mers and their order: a sketch for edit similarity. Texts that
agree in a table are candidates; a banded alignment of their k-mers verifies them. Of texts with few
k-mers a sketch says little: links of up to ``SHORT`` aligned k-mers are found by these themselves.

Equal texts are one node from the start. The members of a bucket are first compared with
one leader, the member that agrees with most others. Only buckets whose members are then still in
several classes are looked at again: blocks of their members are compared by the k-mers they
share, and pairs that share enough are aligned. No class is lost by that, as a pair that is left out
is in one class already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .components import components
from .store import keep

K = 5
#: Similarity of two texts with n and m k-mers of which s are aligned: s / (n + m - s).
SIMILARITY = (4, 5)
TABLES, ELL = 24, 5
#: Links of up to so many aligned k-mers are found by the k-mers left when a text leaves some out.
SHORT = 11
#: k-mers of a text by which members of a bucket are compared first; of longer texts those of least hash, about as many.
COMPARED = 256
#: k-mers of all texts of a block that are counted at once.
COUNTED = 1 << 22
#: Members of a bucket that one task compares with as many others.
BLOCK = 512


def _kmers(texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; its k-mers' hashes, and where they start."""
    found = arrays.words(texts, arrays.ALNUM)
    hashes = arrays.word_hashes(texts, found)
    return np.diff(found.first), *arrays.run_hashes(hashes, found.first, K)


def _occurrences(kmers: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each k-mer stood in its text before."""
    order = np.lexsort((kmers, owner))
    k, o = kmers[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    out = np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
    return out


def _labelled(kmers: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence, so that a text has none twice."""
    return arrays.mixed(kmers + _occurrences(kmers, owner).astype(np.uint64) * np.uint64(arrays.BASE))


def sketches(kmers: np.ndarray, first: np.ndarray, tables: int = TABLES, ell: int = ELL) -> np.ndarray:
    """[text, table] bucket keys; texts without k-mers have zeros.

    Only k-mers with a hash below a bound are sorted. The bound lets 3 * ell through on average; it is
    lifted for texts in which fewer than they need came through.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    labelled = _labelled(kmers, owner)
    keys = np.zeros((len(counts), tables), np.int64)
    need = np.minimum(counts, ell)
    top = np.iinfo(np.uint64).max
    share = np.minimum(3.0 * ell / np.maximum(counts, 1), 1)
    usual = np.repeat(np.where(share < 1, (share * float(2**63)).astype(np.uint64) * np.uint64(2), top), counts)
    factors = arrays.seeds(2 * tables, 2000)
    parts = arrays.seeds(ell, 3000)
    for t in range(tables):
        value = (labelled ^ factors[2 * t]) * factors[2 * t + 1]
        value ^= value >> np.uint64(29)
        at = np.flatnonzero(value <= usual)
        got = np.bincount(owner[at], minlength=len(counts))
        if (got < need).any():
            at = np.flatnonzero((value <= usual) | (got < need)[owner])
            got = np.bincount(owner[at], minlength=len(counts))
        at = at[np.lexsort((value[at], owner[at]))]
        rank = np.arange(len(at)) - np.repeat(np.cumsum(got) - got, got)
        at = np.sort(at[rank < ell])
        place = np.arange(len(at)) - np.repeat(np.cumsum(need) - need, need)
        total = np.zeros(len(counts), np.uint64)
        np.add.at(total, owner[at], labelled[at] * parts[place])
        keys[:, t] = arrays.mixed(total ^ factors[2 * t]).view(np.int64)
    keys[counts == 0] = 0
    return keys


def short_keys(kmers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and number left out, for each different sequence of s <= SHORT k-mers that texts get by leaving out as many as a link of s allows.

    Two texts are alike by s aligned k-mers just if they have a key for s in common and leave out s / 4 k-mers together at most.
    """
    up, down = SIMILARITY
    counts = np.diff(first)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    factors = arrays.seeds(SHORT + 1, 5000)
    for s in range(-(-up // (down - up)), SHORT + 1):
        for n in range(s, s + s * (down - up) // up + 1):
            at = np.flatnonzero(counts == n)
            if not len(at):
                continue
            own = kmers[first[at][:, None] + np.arange(n)]
            keys = np.stack([(own[:, left] * factors[:s]).sum(1, dtype=np.uint64) for left in combinations(range(n), s)], 1)
            keys = np.sort(arrays.mixed(keys + factors[SHORT] * np.uint64(s)), 1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            i, j = np.nonzero(new)
            out.append((at[i], keys[i, j].view(np.int64), np.full(len(i), n - s)))
    text, key, left = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], key[order], left[order]


SHORT_KEYS = T.ArrayType(T.StructType([T.StructField("short", T.LongType()), T.StructField("left", T.LongType())]))
SKETCH = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest_a", T.LongType()), T.StructField("digest_b", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("shorts", SHORT_KEYS)]
)


def _sketched(tables: int, ell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in arrays.slices(batch.column(2).fill_null("")):
                n_words, kmers, first = _kmers(texts)
                counts = np.diff(first)
                keys = sketches(kmers, first, tables, ell)
                place = (np.arange(len(kmers)) - np.repeat(first[:-1], counts)).astype(np.uint64)
                digests = []
                for start in (4000, 4001):
                    part = arrays.mixed(kmers * arrays.seeds(1, start)[0] + place * np.uint64(arrays.BASE))
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
                    digests.append(pa.array(arrays.mixed(total[first[1:]] - total[first[:-1]] + n_words.astype(np.uint64)).view(np.int64)))
                used = np.where(counts > 0, tables, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used)]), pa.int32()), pa.array(keys[counts > 0].ravel()))
                text, key, left = short_keys(kmers, first)
                pairs = pa.StructArray.from_arrays([pa.array(key), pa.array(left)], names=["short", "left"])
                shorts = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), pairs)
                part = batch.slice(texts.first, len(texts))
                columns = [part.column(0), part.column(1), pa.array(counts), *digests, lists, shorts]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *SKETCH.names[1:]])

    return run


def aligned(a: list, b: list, similarity: tuple[int, int] = SIMILARITY) -> int | None:
    """k-mers of a and b in the longest common subsequence, if their similarity is reached; else None.

    The alignment goes by the number of k-mers left out (Myers, 1986), on the diagonals that the similarity allows.
    """
    up, down = similarity
    n, m = len(a), len(b)
    least = -(-up * (n + m) // (up + down))
    if not n or not m or least > min(n, m):
        return None
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    a, b = a[start : n - end], b[start : m - end]
    width, height = len(a), len(b)
    if not width or not height:
        return start + end if start + end >= least else None
    band = n + m - 2 * least
    reach = {1: 0}
    for d in range(band + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            y = x - k
            if x > width or y > height:
                reach[k] = x
                continue
            while x < width and y < height and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= width and y >= height:
                common = (width + height - d) // 2 + start + end
                return common if common >= least else None
    return None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows of a, b, text_a, text_b. Pairs that share too few k-mers in any order need no alignment."""
    up, down = SIMILARITY
    for batch in batches:
        found: tuple[list, list, list] = ([], [], [])
        step = 256
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            sides = [_kmer_lists(part.column(column)) for column in (2, 3)]
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                least = -(-up * (len(x) + len(y)) // (up + down))
                if least > min(len(x), len(y)) or not least:
                    continue
                if not _enough(*(_labelled(k, np.zeros(len(k), np.int64)) for k in (x, y))):
                    continue
                if (common := aligned(x.tolist(), y.tolist())) is not None:
                    found[0].append(part.column(0)[i].as_py())
                    found[1].append(part.column(1)[i].as_py())
                    found[2].append(common / (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["u", "v", "similarity"])


LINKS = "u long, v long, similarity double"


def _level(n: np.ndarray) -> np.ndarray:
    """How often a text's k-mers are halved until about ``COMPARED`` are left for the first look."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / COMPARED))).astype(np.int64)


def _prints(kmers: list[np.ndarray]) -> list[bytes]:
    """Prints of the compared k-mers of each text."""
    out = []
    for own in kmers:
        labelled = _labelled(own, np.zeros(len(own), np.int64))
        out.append(labelled[labelled <= (np.uint64(2**64 - 1) >> _level(np.array([len(own)])).astype(np.uint64)[0])].tobytes())
    return out


def _kmer_lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for texts in arrays.slices(column):
        _, kmers, first = _kmers(texts)
        out += [kmers[first[i] : first[i + 1]] for i in range(len(texts))]
    return out


def in_common(prints: list[bytes], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """[text of one, text of two] prints they have in common; as a product of matrices, a slice of prints at a time."""
    counts = np.array([len(p) // 8 for p in prints])
    owner = np.repeat(np.arange(len(prints)), counts)
    values, which, times = np.unique(np.frombuffer(b"".join(prints), np.uint64), return_inverse=True, return_counts=True)
    several = times > 1
    which, owner = (np.cumsum(several) - 1)[which[several[which]]], owner[several[which]]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    out, width = np.zeros((len(one), len(two)), np.int64), 4096
    for at in range(0, int(several.sum()), width):
        i, j = np.searchsorted(which, (at, at + width))
        some = np.zeros((len(prints), width), np.float32)
        some[owner[i:j], which[i:j] - at] = 1
        out += (some[one] @ some[two].T).astype(np.int64)
    return out


def _enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts share enough labelled k-mers in any order; else there is nothing to align."""
    up, down = SIMILARITY
    return (up + down) * len(np.intersect1d(a, b, True)) >= up * (len(a) + len(b))


def _sharing(kmers: list[np.ndarray], one: np.ndarray, two: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Those of the pairs ``fit`` [text of one, text of two] that share enough labelled k-mers in any order, counted over all of them.

    The first look is at the compared k-mers: a pair shares no more than what it shares of these and all the others of the smaller rest.
    What is left is counted whole, a range of hashes at a time.
    """
    up, down = SIMILARITY
    n = np.array([len(own) for own in kmers])
    least = -(-up * (n[one][:, None] + n[two][None]) // (up + down))
    level = np.maximum(_level(n)[one][:, None], _level(n)[two][None])
    prints = _prints(kmers)
    common, fit = in_common(prints, one, two), fit.copy()
    for step in np.unique(level[fit]):
        bound = np.uint64(2**64 - 1) >> np.uint64(step)
        rest = n - [np.count_nonzero(np.frombuffer(own, np.uint64) <= bound) for own in prints]
        fit &= (level != step) | (common + np.minimum(rest[one][:, None], rest[two][None]) >= least)
    i, j = np.flatnonzero((fit & (level > 0)).any(1)), np.flatnonzero((fit & (level > 0)).any(0))
    if len(i):
        asked = np.union1d(one[i], two[j])
        whole = [np.sort(_labelled(kmers[a], np.zeros(len(kmers[a]), np.int64))) for a in asked]
        parts = -(-sum(map(len, whole)) // COUNTED)
        ends = [np.searchsorted(own, np.array([2**64 * k // parts for k in range(1, parts)], np.uint64)) for own in whole]
        cuts = [[0, *end, len(own)] for end, own in zip(ends, whole, strict=True)]
        rows, columns = np.searchsorted(asked, one[i]), np.searchsorted(asked, two[j])
        every = sum(in_common([own[cut[k] : cut[k + 1]].tobytes() for own, cut in zip(whole, cuts, strict=True)], rows, columns) for k in range(parts))
        fit[np.ix_(i, j)] &= every >= least[np.ix_(i, j)]
    return fit


def _compared(group: pa.Table) -> pa.Table:
    """Links among the members of a block, or of two blocks: of pairs that are in two classes, alike in length, and share enough k-mers.

    A pair that links found before have joined is left out.
    """
    up, down = SIMILARITY
    block = group.column("block").to_numpy()
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    row, n, kind = (group.column(c).to_numpy() for c in ("row", "n", "class"))
    one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
    n1, n2 = n[one][:, None], n[two][None]
    fit = (kind[one][:, None] != kind[two][None]) & (np.minimum(n1, n2) * down >= np.maximum(n1, n2) * up)
    fit &= (row[one][:, None] > row[two][None]) | (low != high)
    links: list[tuple] = []
    if fit.any():
        kmers = _kmer_lists(group.column("text"))
        fit = _sharing(kmers, one, two, fit)
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for i, j in zip(*np.nonzero(fit), strict=True):
            a, b = one[i], two[j]
            first, second = root(kind[a]), root(kind[b])
            if first == second or (s := aligned(kmers[a].tolist(), kmers[b].tolist())) is None:
                continue
            joined[first] = second
            links.append((max(row[a], row[b]), min(row[a], row[b]), s / (n[a] + n[b] - s)))
    return pa.table([pa.array([x[i] for x in links], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["u", "v", "similarity"])


def _short_pairs(sketched: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all texts with links of up to ``SHORT`` aligned k-mers: of each sequence of k-mers, the text that leaves out fewest with each other text."""
    up, down = SIMILARITY
    shorts = keep(sketched.where(F.size("shorts") > 0).select("row", "n", F.inline("shorts")))
    hubs = keep(shorts.groupBy("short").agg(F.min(F.struct("left", "row")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("short", "hub"))
    together = (F.col("left") + F.col("hub.left")) * up <= (F.col("n") - F.col("left")) * (down - up)
    return shorts.join(hubs, "short").where((F.col("row") != F.col("hub.row")) & together).select(F.col("row").alias("a"), F.col("hub.row").alias("b"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among pairs of rows, by their texts."""
    one = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    return keep(two.select("a", "b", "text_a", "text_b").mapInArrow(_verified, LINKS))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tables: int = TABLES, ell: int = ELL) -> DataFrame:
    """A row for each row of ``docs``: row, doc_id, class_id, class_size, kept, n_links.

    Words are runs of ASCII letters, digits and anything not ASCII, A-Z lower-cased. A class holds what a
    chain of links joins; its id is its smallest doc_id, and that row is kept (null ids come last, one of
    repeated rows is kept). ``n_links`` counts links that were verified between the row's text and
    different ones. A text of fewer than ``K`` words is a k-mer of its own, so only equal ones join;
    all texts without words are one class. An empty table gives no rows; other columns are not read.
    """
    row = F.monotonically_increasing_id().alias("row")
    return _classes(keep(docs.select(row, F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))), tables, ell)


def _classes(numbered: DataFrame, tables: int = TABLES, ell: int = ELL) -> DataFrame:
    """The classes of row, doc_id, text, which are read twice and so have to be written down."""
    schema = T.StructType([SKETCH["row"], numbered.schema["doc_id"], *SKETCH.fields[1:]])
    sketched = keep(numbered.mapInArrow(_sketched(tables, ell), schema))
    digest = ["n", "digest_a", "digest_b"]
    nodes = keep(sketched.groupBy(*digest).agg(F.min("row").alias("node")))
    different = sketched.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    short_pairs = keep(_short_pairs(different))
    exploded = different.select("row", "n", F.posexplode("keys").alias("place", "key"))
    entries = exploded.select("row", "n", F.xxhash64("place", "key").alias("key"))
    sizes = keep(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = keep(entries.join(sizes, "key"))
    members = keep(met.join(met.groupBy("row").agg(F.sum("size").alias("weight")), "row"))
    # The rows grow with the documents, so they are not broadcast where there happen to be few.
    asked = members.select("row").union(short_pairs.select("a")).union(short_pairs.select("b")).distinct().hint("merge")
    texts = keep(numbered.join(asked, "row", "left_semi").select("row", F.coalesce("text", F.lit("")).alias("text")))

    first = F.max(F.struct("weight", (-F.col("row")).alias("least"), "n"))
    leaders = keep(members.groupBy("key").agg(first.alias("first")).select("key", (-F.col("first.least")).alias("leader"), F.col("first.n").alias("leader_n")))
    alike = "row <> leader AND least(n, leader_n) * 5 >= greatest(n, leader_n) * 4"
    pairs = keep(members.join(leaders, "key").where(alike).select(F.col("row").alias("a"), F.col("leader").alias("b")).unionByName(short_pairs).distinct())
    links = _verify(pairs, texts)
    # Labels for now: the least leader that a row is linked with, and what that one is linked with. Rows of one class may
    # still differ in them, which only makes more pairs to compare.
    linked = keep(links.groupBy(F.col("u").alias("row")).agg(F.min("v").alias("class")).where("class < row"))
    further = linked.select(F.col("row").alias("class"), F.col("class").alias("further"))
    classes = linked.join(further, "class", "left").select("row", F.coalesce("further", "class").alias("class"))

    placed = keep(members.join(classes, "row", "left").withColumn("class", F.coalesce("class", "row")))
    apart = keep(placed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("key"))
    apart = keep(placed.join(apart, "key", "left_semi"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = apart.join(texts, "row").withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "n", "class", "text")
    links = links.unionByName(keep(dealt.groupBy("key", "low", "high").applyInArrow(_compared, LINKS)))
    found = components(links.select("u", "v"))

    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().select(F.explode(F.array("u", "v")).alias("node"))
    known = nodes.join(found, "node", "left").join(ends.groupBy("node").agg(F.count("*").alias("n_links")), "node", "left")
    known = keep(known.select(*digest, F.coalesce("component", "node").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    placed = keep(sketched.select("row", "doc_id", *digest).join(known, digest).select("row", "doc_id", "class", "n_links"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    winners = keep(placed.groupBy("class").agg(F.min(order).alias("winner"), F.count("*").alias("class_size")))
    return placed.join(winners, "class").select(
        "row", "doc_id", F.col("winner.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("winner.row")).alias("kept"), "n_links"
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    row = "row number of near dedup"
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    picked = numbered.select(F.col(row).alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    gone = _classes(picked).where("not kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
