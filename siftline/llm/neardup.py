"""Near-duplicate texts: SimHash links, verified, and an exact join for what they leave apart.

Texts are alike if the sets of their ``width``-word shingles have a Jaccard similarity of
``similarity`` or more; groups are the components of all such links. One pass over the texts
keeps a fingerprint of word pairs, the first fifth of the shingles as hashes, and parities of them
all: two bits a shingle at most, which tell nearly all pairs that are not alike. The sets of the
others' texts are made again from the texts. Fingerprints are linked by the
vantage-point trees of ``simhash``, the links are verified on the whole sets, and unite most of
each group cheaply. What is still apart is found by shared tokens: in any one order of all
shingles, rare before frequent, two sets that are alike share one of their first fifth. First
neighbours within a token are tried, then every pair that sizes and places allow, so neither
the fingerprints' radius nor the length of a text limits what is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mixed, release, small, sweep, text_keys, thrifty
from .components import components
from .simhash import near_links

#: Texts that the frequent shingles are learned from, and how many of those are known, at most.
#: They only decide how many pairs are compared.
SAMPLE, FREQUENT = 4_000, 1 << 16
#: Words of the fingerprints' shingles and the bits in which linked ones may differ.
CANDIDATE_WIDTH, CANDIDATE_BITS = 2, 9
_STEPS = np.random.default_rng(2).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None, *widths: int) -> list[np.ndarray]:
    """For each width the hashes of a text's shingles, in order; A-Z lower-cased, none without words.

    A text of fewer words than ``width`` has one shingle, of all its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = []
    for width in widths:
        use = min(width, len(h))
        n = len(h) - use + 1 if use else 0
        total = np.full(n, use, np.uint64)
        for k in range(use):
            total += h[k : n + k] * _STEPS[k]
        out.append(mixed(total))
    return out


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes, as a signed 64-bit number."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(np.int64)[0])


def shingle_sets(plain: DataFrame, key: str, width: int) -> DataFrame:
    """(key, shingles) of (key, text): the different shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                sets = [np.unique(grams(text.as_py(), width)[0]).view(np.int64) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], [key, "shingles"])

    return plain.select(key, "text").mapInArrow(thrifty(run), f"{key} long, shingles array<long>")


def frequent_shingles(plain: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, log2 of their counts): shingles that a bounded sample of the texts repeats, ``total`` rows."""
    grain = 1 << 24
    taken = plain.where(F.pmod(F.xxhash64("k1", F.lit(11)), F.lit(grain)) < min(grain, math.ceil(grain * SAMPLE / max(1, total))))
    each = shingle_sets(taken.dropDuplicates(["k1", "k2"]), "k1", width).select(F.explode("shingles").alias("token"))
    often = each.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token = often.column("token").to_numpy().view(np.uint64)
    at = np.argsort(token)
    return token[at], np.log2(often.column("count").to_numpy()[at]).astype(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each cell has an odd number of the hashes, as longs: as many bits as hashes at least, a power of two from 256 on.

    The first and the second half, xored, are the parities of half as many cells.
    """
    cells = max(256, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sketches(plain: DataFrame, width: int, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, k1, k2, fp, n, tokens, bits) of (id, k1, k2, text): the fingerprint, the number of shingles, the first of them, parities.

    In any one order of all shingles, two sets whose Jaccard similarity is ``similarity`` or more
    have one of their first n - ceil(similarity * n) + 1 in common. The order here is rare before
    frequent, then by hash. Two sets differ in at least as many shingles as their parities do.
    A text without words has the one token 0. The shingles themselves take more than the text, and
    are made again for the few texts whose sets are compared.
    """
    known, weight = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch, prints, n, tokens, bits = whole.slice(at, 128), [], [], [], []
                for text in batch.column(3):
                    pairs, own = grams(text.as_py(), CANDIDATE_WIDTH, width)
                    prints.append(majority(pairs))
                    own = np.unique(own)
                    place = np.searchsorted(known, own)
                    place[place == len(known)] = 0
                    rank = np.where(known[place] == own, weight[place], 0) if len(known) else np.zeros(len(own), np.int64)
                    first = own[np.argsort(rank, kind="stable")][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
                    n.append(len(own))
                    tokens.append(first.view(np.int64) if len(own) else np.zeros(1, np.int64))
                    bits.append(parities(own))
                made = [pa.array(prints, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, longs), pa.array(bits, longs)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["id", "k1", "k2", "fp", "n", "tokens", "bits"])

    columns = "id long, k1 long, k2 long, fp long, n long, tokens array<long>, bits array<long>"
    return plain.select("id", "k1", "k2", "text").mapInArrow(thrifty(run), columns)


def shared_tokens(starts: DataFrame) -> DataFrame:
    """(tx, n, pos, token): the tokens that two texts have, most others being of one text alone."""
    # one shuffle serves the counts and the rows; a token of very many texts is rows of four numbers
    each = starts.select("tx", "n", F.posexplode("tokens").alias("pos", "token"))
    texts = F.count("*").over(Window.partitionBy("token"))
    out = materialise(each.withColumn("texts", texts).where("texts > 1").select("tx", "n", "pos", "token"), "tokens")
    sweep(starts.sparkSession)
    return out


def apart(tokens: DataFrame, roots: DataFrame, total: int, similarity: float, every: bool, tried: DataFrame) -> DataFrame:
    """(u, v), u > v, without those ``tried``: texts of different ``roots``, ``total`` rows, that share one of the ``tokens``.

    With ``every``, all such pairs that sizes and places allow; else only neighbours within a
    token, whose number is that of the tokens at most. A token's largest group is paired with
    the others only, so what is united already costs no pairs.
    """
    each = tokens.join(small(roots, rows=total), "tx").select("tx", "root", "n", "pos", "token")
    # a token of one group has no pairs; counts of groups are combined before they are shuffled
    held = each.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    held = materialise(held, "held")
    open_ = materialise(each.join(small(held), "token"), "open")
    fair = F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9
    if not every:
        order = Window.partitionBy("token").orderBy("n", "tx")
        found = open_.withColumns({c + "2": F.lag(c).over(order) for c in ("tx", "root", "n")}).where("root != root2")
    else:
        largest = open_.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
        few = open_.join(largest, "token").where("root != largest")
        other = open_.select("token", *[F.col(c).alias(c + "2") for c in ("tx", "root", "n", "pos")])
        # at the first token that two sets share, no more can be common than what follows in both
        room = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-9
        found = few.join(other, "token").where("root != root2 AND (root2 = largest OR tx > tx2)").where(room)
    found = found.where(fair).select(F.greatest("tx", "tx2").alias("u"), F.least("tx", "tx2").alias("v")).distinct()
    out = materialise(found.join(tried, ["u", "v"], "left_anti"), "pairs")
    for done in (held, open_):
        release(done)
    return out


def differing(a: Column, b: Column) -> Column:
    """In how many bits two ``parities`` differ, the larger folded to the size of the other; 0 if it is over twice that."""
    half = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(x)
    each = F.zip_with(fit(a, b), fit(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    total = F.aggregate(each, F.lit(0), lambda t, x: t + x)
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)), total).otherwise(0)


def alike(sets_of: Callable[[DataFrame, int], DataFrame], starts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame | None:
    """The ``pairs`` (u, v) whose whole sets of shingles are as similar as ``similarity`` or more; None if there are none.

    ``sets_of`` gives the sets of a table of texts, of so many rows at most.
    """
    u = starts.select(F.col("tx").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    v = starts.select(F.col("tx").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
    # sets whose sizes or parities alone rule the similarity out are neither made nor joined
    near = F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9
    few = differing(F.col("bu"), F.col("bv")) <= (F.col("nu") + F.col("nv")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    fair = materialise(pairs.join(u, "u").join(v, "v").where(near & few).select("u", "v"), "fair")
    rows = fair.count()
    if not rows:
        release(fair)
        return None
    sets = materialise(sets_of(fair.select(F.explode(F.array("u", "v")).alias("tx")).distinct(), 2 * rows), "sets")
    # u's set goes to v, once a pair; v's goes once, whatever the number of its pairs
    a = sets.select(F.col("tx").alias("u"), F.col("shingles").alias("a")).join(small(fair, rows=rows), "u")
    b = sets.select(F.col("tx").alias("v"), F.col("shingles").alias("b")).join(small(fair.select("v").distinct(), rows=rows), "v", "left_semi")
    held = a.join(b, "v")
    common = F.size(F.array_intersect("a", "b"))
    whole = (common >= similarity * (F.size("a") + F.size("b") - common)) | ((F.size("a") == 0) & (F.size("b") == 0))
    out = materialise(held.where(whole).select("u", "v"), "alike")
    release(fair)
    release(sets)
    del held, a, b, sets
    sweep(pairs.sparkSession)
    return None if out.isEmpty() else out


def _united(roots: DataFrame, links: DataFrame | None) -> DataFrame:
    """``roots`` (tx, root) with those that ``links`` (u, v) of texts join made one, the smallest."""
    if links is None:
        return roots
    u, v = (roots.select(F.col("tx").alias(c), F.col("root").alias("r" + c)) for c in "uv")
    found = components(links.join(u, "u").join(v, "v"), "ru", "rv")
    merged = roots.join(found, F.col("root") == F.col("node"), "left").select("tx", F.coalesce("component", "root").alias("root"))
    return materialise(merged, "roots")


def verified(sets_of: Callable[[DataFrame, int], DataFrame], starts: DataFrame, pairs: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``roots`` with those made one that a pair (u, v), u > v, of texts alike joins.

    Each text is compared with the least of its partners first, which unites most of what belongs
    together while every set is sent once; then all pairs that are still apart are compared.
    """
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("v")), "least")
    roots = _united(roots, alike(sets_of, starts, least, similarity))
    u, v = (roots.select(F.col("tx").alias(c), F.col("root").alias("r" + c)) for c in "uv")
    rest = pairs.join(least, ["u", "v"], "left_anti").join(u, "u").join(v, "v").where("ru != rv").select("u", "v")
    roots = _united(roots, alike(sets_of, starts, rest, similarity))
    release(least)
    return roots


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(k1, k2, id, n1, n2): each different text's key, the smallest id of its group, that id's text's key.

    Shingles are 64-bit hashes where candidates are sought and 32-bit ones where two sets are
    compared. Null texts count as empty; texts without words are alike. Ids that are null name a group
    only where no other does. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), *text_keys(text), text.alias("text"))
    often = frequent_shingles(plain, docs.count(), width)
    held = materialise(sketches(plain, width, similarity, often).withColumn("tx", F.monotonically_increasing_id()), "sketches")
    # of copies of a text one row stands for all
    texts = held.groupBy("k1", "k2").agg(F.min("tx").alias("tx"), F.min("id").alias("id"), F.min("fp").alias("fp"))
    texts = materialise(texts, "texts")
    total = texts.count()
    starts = held.select("tx", "n", "bits")
    # the copies are fewer than the texts, and broadcast where those are not, so that no tokens are shuffled for it
    copies = materialise(held.select("tx", "k1", "k2").join(texts.select("k1", "k2", F.col("tx").alias("one")), ["k1", "k2"]).where("tx != one").select("tx"), "copies")
    tokens = shared_tokens(held.select("tx", "n", "tokens").join(small(copies), "tx", "left_anti"))

    def sets_of(chosen: DataFrame, rows: int) -> DataFrame:
        wanted = texts.join(chosen, "tx", "left_semi").select("tx", "k1", "k2")
        each = shingle_sets(plain.join(small(wanted, rows=rows), ["k1", "k2"]), "tx", width)
        # half of each hash does for counting what two sets have in common, and halves what is shuffled
        half = F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int"))
        return each.select("tx", half.alias("shingles")).groupBy("tx").agg(F.first("shingles").alias("shingles"))

    nodes = materialise(texts.groupBy("fp").agg(F.min("tx").alias("rep")), "nodes")
    same = texts.join(nodes, "fp").where("tx != rep").select(F.col("tx").alias("u"), F.col("rep").alias("v"))
    pairs = near_links(nodes, CANDIDATE_BITS).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = [materialise(same.union(pairs), "pairs")]
    del pairs, same
    sweep(docs.sparkSession)
    roots = verified(sets_of, starts, found[0], texts.select("tx", F.col("tx").alias("root")), similarity)
    for every in (False, True):
        found.append(apart(tokens, roots, total, similarity, every, reduce(DataFrame.union, found)))
        roots = verified(sets_of, starts, found[-1], roots, similarity)
    named = texts.join(roots, "tx")
    # an id can have several texts, so the text that names the group is kept beside its id
    least = named.groupBy("root").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k1", "k2"))).alias("least"))
    out = named.join(least, "root").select("k1", "k2", "least.id", F.col("least.k1").alias("n1"), F.col("least.k2").alias("n2"))
    out = materialise(out, "groups")
    for done in (held, copies, tokens, nodes, *found):
        release(done)
    sweep(docs.sparkSession)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` whose id and text name their group: one document of each group stays.

    Groups and ``limits`` are ``near_duplicate_groups``'. Of repeated rows with that id and text
    the one whose columns come first in order stays (unrelated texts under one id all do); rows
    without an id stay, as they can't be told apart. Columns are those of ``docs``, whatever
    their names; an empty table gives an empty one.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, **limits)
    names = groups.where("k1 = n1 AND k2 = n2").select(F.col("id").alias("name"), "k1", "k2")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("id"), *text_keys(text), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    keys = ["id", "k1", "k2"]
    counts = each.groupBy(*keys).agg(F.count("*").alias("n"))
    twice = small(materialise(counts.where("n > 1 AND id IS NOT NULL").select(*keys), "twice"))
    # what goes is less than what stays, and broadcast where that is not, so that no text is shuffled for it: texts that
    # name no group, and of those that do and have several ids, all but one
    gone = small(materialise(groups.where("k1 != n1 OR k2 != n2").select("k1", "k2"), "gone"))
    several = counts.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2")
    named = small(materialise(names.join(several, ["k1", "k2"], "left_semi"), "named"))

    def stay(rows: DataFrame) -> DataFrame:
        left = rows.join(gone, ["k1", "k2"], "left_anti").join(named, ["k1", "k2"], "left")
        return left.where("id IS NOT NULL AND (name IS NULL OR id = name)").select(*keys, "row")

    once = stay(each.join(twice, keys, "left_anti")).select("row.*")
    least = stay(each.join(twice, keys, "left_semi")).groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.union(least).union(each.where("id IS NULL").select("row.*"))
