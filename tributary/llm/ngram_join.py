"""N-gram Jaccard join with several global token orders.

Tokens are a text's distinct word shingles. In any global order of tokens, two sets of Jaccard similarity t or more
share a token among the first ``n - ceil(t n) + 1`` of each (for the smaller set, ``n - ceil(2 t n / (1 + t)) + 1``).
Three orders are used: rare tokens first, by classes of document frequency; common tokens first; and by hash alone. Texts
that share rare tokens by chance seldom share common or random ones, too. A pair is a candidate only if the prefixes meet
in every order, and only then are the sets compared; this holds for every pair that any step below makes.

1. ``exchange`` tells each document how frequent its shingles are in the whole corpus. A document of which too few
   shingles occur elsewhere has no partner. (Shingle fingerprints there are 32 bits within a bucket of the hash space;
   a collision only makes a shingle look more frequent, for all documents alike.)
2. Documents with equal sets are one class, represented by the smallest doc_id.
3. Each representative is compared with the most central one that has the same first token; then, for each prefix token
   that several components share, one member of each with the most central one. The links of these stars join large
   groups of near copies without making their pairs.
4. Representatives of different components that share a prefix token, and from there on have enough shared shingles to
   be similar at their sizes, are candidates under the first order. Pairs inside one component need no comparison.
5. Components of all links between stars, by large-star and small-star rounds.

No link between different texts is lost: a pair is left out only if its ends are joined already or a filter that every
link passes rejects it.

Defined results: a text of fewer words than ``width`` is one shingle of all its words; a null, empty or wordless text
has none and links with nothing; rows with equal doc_id are one document with the links of all its texts; a null doc_id
links with nothing and has a null component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.exchange import ask, bucket_base, bucket_edges, n_buckets, n_groups, pack, sizes, tell, unpack, with_group
from tributary.llm.kernel import mix, shingle_sets
from tributary.operators.graph import components
from tributary.session import save

WIDTH = 5
#: Similarity as a fraction, so that the comparison is in integers.
SIMILAR = (75, 100)
#: Rows of one key beyond which it may be split.
HOT = 200
_SECOND, _THIRD, _SET = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)

_PROFILE = "doc_id long, n long, m long, d1 long, d2 long, n_probe int, n_index int, first array<long>, second array<int>, third array<int>, text string"


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _fingerprint_shift(buckets: int) -> int:
    return max(0, ((1 << 64) // buckets).bit_length() - 32)


def _sender(buckets: int, width: int):
    shift = np.uint64(_fingerprint_shift(buckets))

    def send(table: pa.Table):
        sets = shingle_sets(table.column("text"), width)
        token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        edges = bucket_edges(token, buckets)
        used = np.flatnonzero(np.diff(edges))
        keys, values = [], []
        for b in used.tolist():
            part = slice(edges[b], edges[b + 1])
            mark = ((token[part] - bucket_base(b, buckets)) >> shift).astype(np.uint32)
            keys.append(pack(np.diff(mark, prepend=np.uint32(0))))
            values.append(pack(count[part].astype(np.uint32)))
        return used, keys, values

    return send


def _answer(keys: list[bytes], values: list[bytes]) -> list[bytes]:
    """For each fingerprint sent, its class of document frequency: 0 for one document, else growing with the logarithm."""
    marks = [np.cumsum(unpack(k, np.uint32), dtype=np.uint32) for k in keys]
    mark = np.concatenate(marks)
    distinct, place = np.unique(mark, return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack(v, np.uint32) for v in values]), len(distinct))
    grade = np.where(total > 1, np.minimum(255, 1 + np.floor(7 * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)[place]
    return [part.tobytes() for part in np.split(grade, np.cumsum([len(m) for m in marks])[:-1])]


def _profiler(buckets: int, width: int, similar: tuple[int, int]):
    num, den = similar

    def use(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        sets = shingle_sets(table.column("text"), width)
        token = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        edges = bucket_edges(token, buckets)
        grade = np.zeros(len(token), np.uint8)
        for b, raw in replies.items():
            grade[edges[b] : edges[b + 1]] = np.frombuffer(raw, np.uint8)
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text")
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "m", "d1", "d2", "n_probe", "n_index", "first", "second", "third", "text")}
        seen: set[tuple[int, int, int]] = set()
        for row in sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0)):
            own = sets[row]
            n = len(own)
            values = dict.fromkeys(out)
            values["doc_id"], values["n"] = ids[row], n
            if n and ids[row] is not None:
                g = grade[np.searchsorted(token, own)]
                shared = own[g > 0]
                values["m"] = len(shared)
                probe = len(shared) - _ceil(num * n, den) + 1
                if probe > 0:
                    values["d1"] = int(mix(own).sum(dtype=np.uint64).view(np.int64))
                    values["d2"] = int(mix(own ^ _SET).sum(dtype=np.uint64).view(np.int64))
                    values["n_probe"] = probe
                    values["n_index"] = max(0, len(shared) - _ceil(2 * num * n, num + den) + 1)
                    key = values["d1"], values["d2"], n
                    if key not in seen:
                        seen.add(key)
                        g = g[g > 0]
                        values["first"] = shared[np.lexsort((shared, g))[:probe]].view(np.int64)
                        for name, lane, rank in (("second", _SECOND, 255 - g), ("third", _THIRD, np.zeros_like(g))):
                            other = mix(shared ^ lane)
                            values[name] = (other[np.lexsort((other, rank))[:probe]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        values["text"] = texts[row].as_py()
            for k, v in values.items():
                out[k].append(v)
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "m": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "n_probe": pa.int32(), "n_index": pa.int32(), "first": pa.list_(pa.int64()), "second": pa.list_(pa.int32()), "third": pa.list_(pa.int32()), "text": pa.string()}
        return pa.table({k: pa.array(out[k], kind) for k, kind in kinds.items()})

    return use


def _links(pairs: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """Rows (a, text_a, b, text_b) whose shingle sets are similar, as (src, dst)."""
    num, den = similar

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = _sets_once(batch.column(0), batch.column(1), width)
            right = _sets_once(batch.column(2), batch.column(3), width)
            good = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], ["src", "dst"])

    return pairs.select("a", "text_a", "b", "text_b").mapInArrow(compare, "src long, dst long")


def _verified(pairs: DataFrame, reps: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """The candidates (a, b) of the first order whose prefixes meet in the second and the third, too, and whose sets are
    similar, as (src, dst). ``pairs`` is a saved table."""
    hot = _hot(pairs)
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("second").alias(f"second_{x}"), F.col("third").alias(f"third_{x}"))
    text = lambda x: reps.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
    both = lambda rows, of: _fetch(_fetch(rows, "a", "b", of("a"), hot), "b", "a", of("b"), hot)
    met = both(pairs, side).where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    return _links(both(save(met.select("a", "b"), "ngram-candidates"), text), width, similar)


def _hot(pairs: DataFrame) -> DataFrame | None:
    """(side, key, parts) of the ends of pairs with more than a thousandth of them (HOT at least): two thousand rows at
    most; None if there are none."""
    ends = pairs.select(F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("key")) for x in "ab"))).alias("e"))
    most = save(ends.groupBy("e.side", "e.key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "ngram-hot")
    total = most.agg(F.sum("n")).first()[0]
    if total is None:
        return None
    limit = max(HOT, total // 2000)
    return most.where(F.col("n") > limit).select("side", "key", F.ceil(F.col("n") / limit).cast("long").alias("parts"))


def _fetch(pairs: DataFrame, side: str, other: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``pairs`` joined with ``table`` (a row a key, in column ``side``). Pairs of a hot key are split by their other end,
    and its row is repeated for each part, so that no task gets them all."""
    if hot is None:
        return pairs.join(table, side)
    own = F.broadcast(hot.where(F.col("side") == side).select(F.col("key").alias(side), "parts"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    salted = pairs.join(own, side, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts)).drop("parts")
    spread = table.join(own, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return salted.join(spread, [side, "_part"]).drop("_part")


def _with_token(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` joined with ``tokens`` (token, size and more, a row a token). Rows of tokens with more than a thousandth of
    all rows (HOT at least), of which there are a thousand at most, meet a broadcast and are not shuffled."""
    tokens = save(tokens, "ngram-tokens")
    total = tokens.where(F.col("size") > HOT).agg(F.sum("size")).first()[0]
    limit = max(HOT, (total or 0) // 1000)
    hot, cold = F.broadcast(tokens.where(F.col("size") > limit)), tokens.where(F.col("size") <= limit)
    rest = rows.join(hot.select("token"), "token", "left_anti")
    return rows.join(hot, "token").unionByName(rest.join(cold, "token")).drop("size")


def _sets_once(ids: pa.Array, texts: pa.Array, width: int) -> list[np.ndarray]:
    """The shingle set of each row; a document that comes again and again is cut once a batch."""
    number: dict[tuple, int] = {}
    rows = [number.setdefault(k, len(number)) for k in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
    sets = shingle_sets(pa.array([t for _, t in number], pa.large_string()), width)
    return [sets[k] for k in rows]


def join(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = sizes(docs)
    buckets = n_buckets(*size)
    keyed = with_group(docs, n_groups(*size))
    answers = ask(keyed, _sender(buckets, width), _answer)
    profiles = save(tell(keyed, answers, _profiler(buckets, width, similar), _PROFILE), "ngram-profiles", "zstd")

    sets = ["d1", "d2", "n"]
    classes = save(profiles.where("n_probe is not null").groupBy(*sets).agg(F.min("doc_id").alias("rep")), "ngram-classes", "zstd")
    able = profiles.where("first is not null").join(classes.select(*sets, F.col("rep").alias("doc_id")), [*sets, "doc_id"], "left_semi")
    kept = ["n", "m", "n_probe", "n_index", "first", "second", "third", "text"]
    reps = save(able.select(F.col("doc_id").alias("rep"), *kept), "ngram-reps", "zstd")
    num, den = similar
    # Sizes that allow the similarity, and enough shared shingles for the overlap that it takes: den o >= num (na + nb - o).
    sized = (F.col("na") <= F.col("nb")) & (F.col("na") * den >= F.col("nb") * num)
    enough = F.least("ma", "mb") * (num + den) >= (F.col("na") + F.col("nb")) * num

    # Stars: each representative against the hub of its first token. A hub has that first token itself, so it has no hub.
    # The hub is the most central text, with the smallest share of shingles that are found nowhere else: copies of one
    # original often resemble it, but not each other.
    central = (1 - F.col("m") / F.col("n")).alias("apart")
    rays = reps.select("rep", F.get("first", F.lit(0)).alias("token"), "n", "m", central)
    hubs = rays.groupBy("token").agg(F.min(F.struct("apart", "rep", "n", "m")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    stars = _with_token(rays, hubs).where("rep <> hub.rep")
    stars = stars.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.least("hub.n", "n").alias("na"), F.greatest("hub.n", "n").alias("nb"), F.col("hub.m").alias("ma"), F.col("m").alias("mb"))
    stars = save(stars.where(sized & enough).select("a", "b").distinct(), "ngram-stars")
    star_links = save(_verified(stars, reps, width, similar), "ngram-star-links")
    # An id with several texts can have several hubs; the others count as links.
    above = star_links.groupBy(F.col("dst").alias("rep")).agg(F.min("src").alias("hub"), F.collect_set("src").alias("all"))
    second = above.where(F.size("all") > 1).select(F.explode("all").alias("src"), F.col("rep").alias("dst"))
    named = reps.select("rep", "n", "m", "n_index", "first", central).join(above.select("rep", F.col("hub").alias("component")), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))

    # Postings of prefix tokens that several components share. At the first token that two sets share, all they have in
    # common comes from there on; so ``m``, which bounds the overlap, counts a posting's shared shingles from its token on.
    postings = save(
        named.select("rep", "n", "m", "apart", "component", "n_index", F.posexplode("first").alias("pos", "token"))
        .withColumn("indexed", F.col("pos") < F.col("n_index"))
        .withColumn("m", F.col("m") - F.col("pos"))  # shared shingles from this token on
        .drop("n_index", "pos"),
        "ngram-postings",
        "zstd",
    )
    several = save(_shared(postings), "ngram-mixed", "zstd")

    # The most central member of each of these components against the most central one of the token.
    best = F.min(F.struct("apart", "rep", "component", "n", "m"))
    hubs = several.groupBy("token").agg(best.alias("hub"), F.count("*").alias("size"))
    members = _with_token(several.groupBy("token", "component").agg(best.alias("x")), hubs).where("component <> hub.component")
    spokes = members.select(F.col("hub.rep").alias("a"), F.col("x.rep").alias("b"), F.least("hub.n", "x.n").alias("na"), F.greatest("hub.n", "x.n").alias("nb"), F.col("hub.m").alias("ma"), F.col("x.m").alias("mb"))
    spokes = save(spokes.where(sized & enough).select("a", "b").distinct(), "ngram-spokes")
    spoke_links = save(second.unionByName(_verified(spokes, reps, width, similar)), "ngram-spoke-links")
    star_of = save(named.select("rep", "component").distinct(), "ngram-stars", "zstd")
    merged = _bridged(spoke_links, star_of)
    several = several.join(merged, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
    several = save(_shared(several), "ngram-mixed", "zstd")

    # Candidates of the first order between components: only where some sizes of both sides fit.
    n, m = (lambda f, x: f(F.when(F.col("indexed"), F.col(x)))), F.max("m").alias("m")
    present = several.groupBy("token", "component").agg(n(F.min, "n").alias("lo"), n(F.max, "n").alias("hi"), F.max("n").alias("top"), F.min("n").alias("low"), m)
    left = present.where("lo is not null").select("token", F.col("component").alias("ca"), "lo", "hi", F.col("m").alias("ma"))
    right = present.select("token", F.col("component").alias("cb"), "low", "top", F.col("m").alias("mb"))
    fits = (F.col("lo") <= F.col("top")) & (F.col("hi") * den >= F.col("low") * num) & (F.least("ma", "mb") * (num + den) >= (F.col("lo") + F.greatest("lo", "low")) * num)
    meet = left.join(right, "token").where((F.col("ca") != F.col("cb")) & fits).select("token", "ca", "cb", "low", "top", F.col("mb").alias("most"))
    # A member of the smaller side stays where the other side's range of sizes and overlaps still allows a partner.
    possible = (F.col("na") <= F.col("top")) & (F.col("na") * den >= F.col("low") * num) & (F.least("ma", "most") * (num + den) >= (F.col("na") + F.greatest("na", "low")) * num)
    small = several.where("indexed").select("token", F.col("component").alias("ca"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"))
    large = several.select("token", F.col("component").alias("cb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    pairs = meet.join(small, ["token", "ca"]).where(possible).join(large, ["token", "cb"]).where(sized & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links = save(_verified(save(pairs, "ngram-pairs"), reps, width, similar), "ngram-links")

    # A document with several texts joins their classes.
    again = profiles.where("n_probe is not null").select("doc_id", *sets).distinct().groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    owned = profiles.join(save(again, "ngram-repeated"), "doc_id", "left_semi").join(classes, sets).select("doc_id", "rep")
    owned = owned.join(owned.groupBy("doc_id").agg(F.min("rep").alias("dst")), "doc_id").select(F.col("rep").alias("src"), "dst").where("src <> dst").distinct()

    final = _bridged(links.unionByName(spoke_links).unionByName(owned), star_of)
    rooted = star_of.join(final, "component", "left").select("rep", F.coalesce("root", "component").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    rooted = rooted.join(smallest, "root").select("rep", F.col("least").alias("root"))
    by_set = classes.join(rooted, "rep", "left").select(*sets, F.coalesce("root", "rep").alias("root"))
    found = profiles.select("doc_id", *sets).join(by_set, sets, "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of tokens that more than one component has."""
    mixed = postings.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return _with_token(postings, mixed.select("token", "size"))


def _bridged(links: DataFrame, star_of: DataFrame) -> DataFrame:
    """(component, root) of the components that links between their members join."""
    of = lambda x: star_of.select(F.col("rep").alias(x), F.col("component").alias(f"c_{x}"))
    bridges = links.join(of("src"), "src").join(of("dst"), "dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))
    return components(bridges).select(F.col("node").alias("component"), F.col("component").alias("root"))


def keep_one(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id stays, with all columns;
    of rows with that doc_id the one with the smallest text stays (no text before any; of equal texts that with the smallest
    hash of its columns). Rows with a null doc_id stay."""
    found = save(join(docs, width, similar), "ngram-components")
    lost = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost["doc_id"]), "left_anti")
    rows, distinct, nulls = found.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if rows - nulls == distinct:
        return kept
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*hashed)))
    again = kept.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(first.alias("__row")).select("__row.*")
    return again.unionByName(kept.where(F.col("doc_id").isNull()))
