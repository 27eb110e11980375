"""MinHash near-dedup by an inverted join over signature coordinates.

Every text gets the set of its distinct word shingles, hashed, and a signature of K coordinates, each the least of the set under one
hash function. Texts with equal sets form one class, and only its first row goes on. A representative is posted
under each (coordinate, value) pair. Postings that stand alone can't collide; a document with fewer than T shared
ones can't reach T collisions. Of the others it suffices to look at a prefix, the rarest K - T + 1 coordinates, lone ones included:
two documents with T collisions share one of them. So common passages cost nothing unless they make up most of a text.

Pairs come in rounds. First every posting links its members to the most popular one, whose coordinates have the
longest lists, as an original among its copies has; these pairs are verified on the full sets, which joins nearly all
copies. Then the posting lists are merged again, skipping whatever is already joined. In lists that still hold several components and no
more than `block` members, collisions are counted between members of different components, first over the K coordinates, where T are
needed, then over S of which the K are the first, a byte of each; what reaches both is verified. Longer lists are not expanded: their
members are posted once more, under L coordinates, whose prefix only meets where texts agree in nearly as much as the similarity asks; so a passage that
makes up half of a million texts leaves no list here. Stars and components follow as before. What is still apart within a list is nearly similar
to its whole group; it meets under P coordinates alone and is compared in blocks there, up to the full sets, so that only links leave a task. No
list is capped.

With K = 64 and T = 36, a pair at similarity 0.8 falls below T with a chance of about one in a hundred thousand, and
less the more similar it is; with L = 256 the bound is 4.4 standard deviations down, at 176, with S = 1024 five, at 755; a pair shares none of
P = 8 coordinates with a chance of three in a million. No other pair is lost.

Null and empty texts and texts without words have an empty set and are linked with nothing. Every row is a document
of its own, also where a doc_id repeats. Rows with a null doc_id link like others and never name a component that holds an id; where
none does, component_id is null and the first row is kept. An empty table gives no rows. Memory follows the longest text, at some ten times
its size. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from tidewright.llm.shared import components, forget, ids_for_join, map_rows, materialise

#: Words in a shingle and least similarity, in hundredths, as near-duplicate operators have them unless told otherwise.
SHINGLE, PERCENT = 5, 80
#: Coordinates of a signature, and collisions that make a candidate.
COORDINATES, MATCHES = 64, 36
#: Coordinates of the long signature, of which only candidates get one, and bytes of their sketch.
LONG, SKETCH = 256, 1024
#: Coordinates under which members of long lists meet that are still apart after that, and members that are compared at once there.
PROBES, WIDE = 8, 2048
#: Shingles of a block whose full sets are compared; 16 MB of them.
ENTRIES = 2_000_000
#: Members of a posting list that are compared at once; longer lists go in blocks, each pair of blocks a group.
BLOCK = 512

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))
_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") | 1 for k in range(n)], np.uint64)


_WORD = _constants(1, 1)[0]
_PLACE = _constants(64, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words none."""
    split = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    h = _mixed(np.fromiter(map(xxh3_64_intdigest, split), np.uint64, len(split)))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _WORD + h[k : len(h) - n + 1 + k] * _PLACE[k])
    return np.unique(out)


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """K coordinates: the least of the set under K hash functions, a few thousand shingles at a time."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(multipliers))
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        low = np.minimum(low, ((part ^ (part >> np.uint64(32)))[:, None] * multipliers).min(0))
    return _mixed(low)


def least_matches(coordinates: int, percent: int, deviations: float) -> int:
    """Collisions over so many coordinates that a pair at the similarity has at least, but for a chance told in standard deviations."""
    p = percent / 100
    return int(coordinates * p - deviations * np.sqrt(coordinates * p * (1 - p)))


def _upper(signed: np.ndarray) -> np.ndarray:
    """The upper 32 bits of coordinates."""
    return (signed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(documents: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature of every row; a narrow pass."""

    def start():
        multipliers = _constants(coordinates, 3)

        def each(cols: dict) -> dict:
            sets = [shingles(t, size) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"], "n_shingles": [len(s) for s in sets], "digest": [_digest(s) for s in sets],
                "signature": [_upper(signature(s, multipliers)) if len(s) else None for s in sets],
            }

        return each

    return map_rows(documents, ["doc_id", "text"], "doc_id bigint, n_shingles bigint, digest binary, signature array<int>", start)


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, digest of the set, the sorted set, its long signature and its sketch, for rows that are candidates."""

    def start():
        multipliers = _constants(SKETCH, 3)

        def each(cols: dict) -> dict:
            sets = [shingles(t, size) for t in cols["text"]]
            signed = [signature(s, multipliers) for s in sets]
            sketches = [(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in signed]
            return {"doc_id": cols["doc_id"], "digest": [_digest(s) for s in sets], "hashes": [s.view(np.int64) for s in sets], "long": [_upper(x[:LONG]) for x in signed], "sketch": sketches}

        return each

    return map_rows(documents, ["doc_id", "text"], "doc_id bigint, digest binary, hashes array<bigint>, long array<int>, sketch binary", start)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return joined.filter(F.col("both") * 100 >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _prefixes(signed: DataFrame, matches: int) -> DataFrame:
    """rep, popular, keys: of documents that share at least `matches` coordinates, the shared ones of their prefix.

    signed: rep and signature. popular: members of all lists of the document together.
    """
    posted = signed.select("rep", F.posexplode("signature").alias("k", "value")).select("rep", F.xxhash64("k", "value").alias("key"))
    shared = materialise(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
    # Lone coordinates are the rarest, then shared ones by the length of their lists.
    lists = posted.join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists")).filter(F.size("lists") >= matches)
    popular = F.aggregate("lists", F.lit(0).cast("bigint"), lambda n, x: n + x.n)
    return lists.select("rep", popular.alias("popular"), F.slice("lists", F.lit(1), F.size("lists") - (matches - 1)).alias("lists")).select("rep", "popular", F.col("lists.key").alias("keys"))


def _stars(prefix: DataFrame) -> DataFrame:
    """a < b: every list's members with its most popular one."""
    held = prefix.select("rep", "popular", F.explode("keys").alias("key"))
    centre = held.groupBy("key").agg(F.max(F.struct("popular", (-F.col("rep")).alias("back"))).alias("m"), F.count("*").alias("n")).filter("n > 1")
    centre = materialise(centre.select("key", (-F.col("m.back")).alias("centre")), "near-centres")
    stars = held.join(centre, "key").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    return materialise(stars, "near-pairs")


def _apart(prefix: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prefix (rep, n_shingles, keys) with each document's component, and key, n, entries of the lists that still hold several components."""
    part = prefix.join(joined, prefix.rep == joined.node, "left").drop("node").withColumn("component", F.coalesce("component", "rep"))
    part = materialise(part, "near-parts")
    lists = part.select("component", "n_shingles", F.explode("keys").alias("key")).groupBy("key")
    lists = lists.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("entries"))
    return part, materialise(lists.filter("low <> high").select("key", "n", "entries"), "near-several")


def _compared(part: DataFrame, lists: DataFrame, sets: DataFrame, sizes: DataFrame, coordinates: int, matches: int, percent: int, block: int, exact: bool = False) -> DataFrame:
    """a < b of different components that meet in any of the lists and have enough collisions; exact: and whose full sets have the similarity."""
    blocks = F.ceil(F.col("n") / block)
    if exact:
        blocks = F.greatest(blocks, F.ceil(F.col("entries") / ENTRIES))
    lists = lists.select("key", blocks.cast("int").alias("blocks"))
    members = part.select("rep", "component", F.explode("keys").alias("key")).join(lists, "key")
    members = members.select("*", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("mine"))
    spread = members.select("rep", "component", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("rep", "component", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    own = members.groupBy("rep").agg(F.collect_list("key").alias("keys"))
    spread = spread.join(own.join(sizes, "rep").join(sets.select("rep", "sketch", *(["hashes"] if exact else [])), "rep"), "rep")
    return materialise(spread.groupBy("key", "i", "j").applyInArrow(_compare(coordinates, matches, percent, exact), "a bigint, b bigint"), "near-more")


def near_duplicates(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = materialise(signatures(documents, size, coordinates).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    grouped = rows.filter("n_shingles > 0").groupBy("digest", "n_shingles")
    classes = materialise(grouped.agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc"), F.first("signature").alias("signature")), "near-classes")
    prefix = _prefixes(classes.select("rep", "signature"), matches).join(classes.select("rep", "doc", "digest", "n_shingles", "signature"), "rep")
    prefix = materialise(prefix, "near-prefix")
    sizes = prefix.select("rep", "n_shingles")
    # Texts stay where they are if the candidates' ids can be broadcast. A null id is an id like others.
    wanted = ids_for_join(materialise(prefix.select(F.col("doc").alias("near_doc")).distinct(), "near-wanted"))
    sets = shingle_sets(documents.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("near_doc")), "left_semi"), size)
    named = prefix.select("rep", F.col("doc").alias("near_doc"), F.col("digest").alias("near_digest"))
    sets = sets.join(named, F.col("doc_id").eqNullSafe(F.col("near_doc")) & (F.col("digest") == F.col("near_digest")))
    sets = materialise(sets.dropDuplicates(["rep"]).select("rep", "hashes", "long", "sketch"), "near-sets")

    # First round: every list's members to its most popular.
    near = materialise(_verified(_alike(_stars(prefix), prefix, matches, percent), sets, percent), "near-links")
    # Second round: lists that still hold several components.
    joined = components(near)
    part, several = _apart(prefix.select("rep", "n_shingles", "keys"), joined)
    short, long = several.filter(F.col("n") <= block), several.filter(F.col("n") > block)
    late = materialise(_verified(_compared(part, short, sets, sizes, coordinates, matches, percent, block), sets, percent), "near-late")
    final = components(late, known=joined)
    if long.limit(1).count():
        final = _deeper(part, long, final, sets, sizes, coordinates, matches, percent, block)

    # Every row: its class, the component of that, and the component's smallest doc_id.
    labelled = materialise(classes.join(final, classes.rep == final.node, "left").select("digest", "n_shingles", "doc", F.coalesce("component", "rep").alias("component")), "near-classed")
    first = materialise(labelled.groupBy("component").agg(F.min("doc").alias("component_id")), "near-first")
    named = materialise(labelled.join(first, "component").select("digest", "n_shingles", "component", "component_id"), "near-named")
    full = rows.filter("n_shingles > 0").select("doc_id", "digest", "n_shingles", "row").join(named, ["digest", "n_shingles"]).select("doc_id", "n_shingles", "component_id", "row", "component")
    out = full.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", "row"))
    kept = F.when(F.col("component_id").isNull(), F.col("row") == F.col("component")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    forget(classes, prefix, sets, part, several, near, late, labelled, first)
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _deeper(part: DataFrame, lists: DataFrame, joined: DataFrame, sets: DataFrame, sizes: DataFrame, coordinates: int, matches: int, percent: int, block: int) -> DataFrame:
    """joined with the links among the members of long lists, which are posted under the long signature."""
    members = part.select("rep", F.explode("keys").alias("key")).join(lists, "key", "left_semi").select("rep").distinct()
    signed = materialise(members.join(sets.select("rep", F.slice("long", 1, LONG).alias("signature")), "rep"), "near-signed")
    prefix = materialise(_prefixes(signed, least_matches(LONG, percent, 4.4)), "near-deeper")
    of = part.select(F.col("rep").alias("a"), F.col("component").alias("of_a")), part.select(F.col("rep").alias("b"), F.col("component").alias("of_b"))
    stars = _stars(prefix).join(of[0], "a").join(of[1], "b").filter("of_a <> of_b").select("a", "b")
    signed = signed.join(sizes, "rep")
    stars = _verified(_alike(stars, signed, least_matches(LONG, percent, 4.4), percent), sets, percent)
    joined = components(stars, known=joined)
    part, several = _apart(prefix.select("rep", "keys").join(sizes, "rep"), joined)
    left = part.select("rep", F.explode("keys").alias("key")).join(several, "key", "left_semi").select("rep").distinct()
    probes = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda k: F.xxhash64(k, F.element_at("signature", -k)))
    met = left.join(signed, "rep").select("rep", "n_shingles", probes.alias("keys"))
    part, several = _apart(met, part.select(F.col("rep").alias("node"), "component"))
    return components(_compared(part, several, sets, sizes, coordinates, matches, percent, max(block, WIDE), exact=True), known=joined)


def _alike(pairs: DataFrame, prefix: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs with enough collisions over all coordinates, and sizes that allow the similarity."""
    left = prefix.select(F.col("rep").alias("a"), F.col("n_shingles").alias("size_a"), F.col("signature").alias("sign_a"))
    right = prefix.select(F.col("rep").alias("b"), F.col("n_shingles").alias("size_b"), F.col("signature").alias("sign_b"))
    hits = F.aggregate(F.zip_with("sign_a", "sign_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    sized = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    return pairs.join(left, "a").join(right, "b").filter(sized & (hits >= matches)).select("a", "b")


def _compare(coordinates: int, matches: int, percent: int, exact: bool):
    """Pairs of different components within a block (i = j) or between two blocks that have enough collisions."""
    import pyarrow as pa

    bound = least_matches(SKETCH, percent, 5)

    def run(table: pa.Table) -> pa.Table:
        rep, part, size = (table.column(c).to_numpy() for c in ("rep", "component", "n_shingles"))
        side = table.column("mine").to_numpy() == table.column("i").to_numpy()
        # The sketch begins with a byte of each of the K coordinates, so collisions of these are never undercounted.
        sign = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
        keys, here = [set(k) for k in table.column("keys").to_pylist()], table.column("key")[0].as_py()
        if exact:
            lists = table.column("hashes").combine_chunks()
            cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [values[b:e] for b, e in zip(cuts, cuts[1:], strict=False)]

        def similar(x: int, y: int) -> bool:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            return 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both)

        left = np.flatnonzero(side)
        right = left if table.column("i")[0] == table.column("j")[0] else np.flatnonzero(~side)
        a, b = [], []
        for x in left:
            other = right[(part[right] != part[x]) & (np.minimum(size[right], size[x]) * 100 >= np.maximum(size[right], size[x]) * percent)]
            other = other[(sign[other, :coordinates] == sign[x, :coordinates]).sum(1) >= matches]
            found = other[(sign[other] == sign[x]).sum(1) >= bound]
            if len(found):
                # A pair that meets in several lists is told in the first of them only.
                found = found[np.fromiter((min(keys[x] & keys[y]) == here for y in found), bool, len(found))]
                if exact:
                    found = found[np.fromiter((similar(x, y) for y in found), bool, len(found))]
                a.append(np.minimum(rep[found], rep[x]))
                b.append(np.maximum(rep[found], rep[x]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run
