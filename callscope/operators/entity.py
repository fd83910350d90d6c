"""Entity resolution: similarity join, leader clusters, representatives, previous editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.dates import settled
from callscope.functions.text import signature_tokens, without_year, year_of
from callscope.operators.components import components
from callscope.sources.storage import kept


def tokenised(df: DataFrame, title: str) -> DataFrame:
    """Adds tokens, year and the call-number token (any token that begins with ``num``)."""
    rows = settled(df.withColumn("tokens", signature_tokens(F.col(title))))
    number = F.get(F.filter("tokens", lambda t: F.startswith(t, F.lit("num"))), F.lit(0))
    return rows.withColumns({"year": year_of(F.col(title)), "number": number})


#: Sets with a key above which it is hot and pairs are looked for by longer keys; tokens of the longest keys; edges of a component that one task folds. None changes a result.
HOT, DEPTH, FOLD = 10_000, 3, 200_000
#: Columns of 64 marks each: whether an odd number of a set's tokens has the mark.
MARKS = tuple(f"marks{i}" for i in range(4))


def _lines(sets: DataFrame) -> DataFrame:
    """Sets with ``line``, their tokens rarest first, in place of ``tokens``, its length ``n`` and the set's marks."""
    rows = sets.select("set_id", F.explode("tokens").alias("token"))
    rarity = rows.groupBy("token").agg(F.count("*").alias("df"))
    mark = F.pmod(F.xxhash64("token"), F.lit(64 * len(MARKS))).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), mark % 64)
    marks = [F.bit_xor(F.when(F.floor(mark / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(MARKS)]
    ordered = rows.join(rarity, "token").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("line"), *marks)
    return sets.drop("tokens").join(ordered, "set_id").withColumns({"line": F.col("line.token"), "n": F.size("line")})


def _candidates(lines: DataFrame, least: float, by: tuple, fits) -> DataFrame:
    """Distinct (a, b) of lines that may be similar: exact, whatever is hot.

    Similar sets share ``depth`` of the first n - ceil(least n) + depth tokens of each, for
    every depth up to their overlap. Keys of one token are taken first; sets whose shared
    key is hot are looked for by that key and one more token, and so on; where a pair
    may share no more than the key, it is taken at once. Sets that meet are compared in the
    join by size, places and marks, so that hardly any but similar ones leave it.
    """
    need = F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)).cast("int")
    prefix = lambda depth: F.slice("line", 1, F.least(F.col("n"), F.col("n") - need + depth))
    own = [c for c in lines.columns if c != "line"]
    rows = lines.select(*own, F.posexplode(prefix(1)).alias("place", "key")).withColumn("key", F.array("key"))
    group = [*by, "at"]
    found = None
    for depth in range(1, DEPTH + 1):
        # Keys meet by their hash: sets that it brings together by chance are told apart like any others.
        rows = kept(rows.withColumn("at", F.xxhash64("key")), "set-keys")
        last = depth == DEPTH
        hot = None if last else kept(rows.groupBy(*group).agg(F.count("*").alias("sharing")).filter(F.col("sharing") > HOT), "hot-keys")
        last = last or hot.isEmpty()
        if last:
            met = joined = rows.withColumn("hot", F.lit(False))
        else:
            named = hot.select(*[F.col(c).alias(f"__{c}") for c in group], F.lit(True).alias("hot"))
            met = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group], "left").drop(*[f"__{c}" for c in group]).withColumn("hot", F.coalesce("hot", F.lit(False)))
            joined = met.filter(~F.col("hot") | (F.col("n") * least <= depth + 1e-6))
        x, y = joined.alias("x"), joined.alias("y")
        # Tokens before and after the place that both share bound the overlap.
        both = F.col("x.n") + F.col("y.n")
        bound = F.least("x.place", "y.place") + 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) - 1
        enough = bound * (1 + least) + 1e-6 >= least * both
        sized = (F.col("x.n") >= F.lit(least) * F.col("y.n")) & (F.col("y.n") >= F.lit(least) * F.col("x.n"))
        # Marks that differ are at most as many as the tokens that only one has.
        apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in MARKS[1:]), F.bit_count(F.col(f"x.{MARKS[0]}").bitwiseXOR(F.col(f"y.{MARKS[0]}"))))
        near = apart * (1 + least) <= both * (1 - least) + 1e-6
        # Hot keys stand for pairs that need share no more tokens than the key has; longer keys find the others.
        told = F.lit(True) if last else ~F.col("x.hot") | (both * least <= depth * (1 + least) + 1e-6)
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
        pairs = x.join(y, [F.col("x.at") == F.col("y.at"), *same, fits, sized, told, near, *([enough] if depth == 1 else [])])
        pairs = pairs.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        more = met.filter("hot").select("set_id", "key").join(lines, "set_id").withColumn("token", F.explode(F.array_except(prefix(depth + 1), F.col("key"))))
        rows = more.select(*own, F.lit(0).alias("place"), F.array_sort(F.array_append("key", F.col("token"))).alias("key")).distinct()
    return found.distinct()


def similar_pairs(sets: DataFrame, least: float, by: tuple = ("year",), fits=None) -> DataFrame:
    """Distinct (set_id, year, number, tokens) -> pairs (a, b, similarity) with Jaccard >= ``least``.

    Pairs are of one ``by``, without a clash of call numbers and with a < b, or as the
    condition ``fits`` on x and y says. Candidates go by short keys, tokens are fetched
    for them only.
    """
    clash = F.coalesce(F.col("x.number") != F.col("y.number"), F.lit(False))
    fits = (F.col("x.set_id") < F.col("y.set_id")) & ~clash if fits is None else fits
    lines = kept(_lines(sets), "sets")
    tokens = lambda end, name: lines.select(F.col("set_id").alias(end), F.col("line").alias(name))
    both = F.size(F.array_intersect("p", "q"))
    likeness = both / (F.size("p") + F.size("q") - both)
    pairs = _candidates(lines, least, by, fits).join(tokens("a", "p"), "a").join(tokens("b", "q"), "b")
    return pairs.select("a", "b", likeness.alias("similarity")).filter(F.col("similarity") >= least)


def _folded(batches):
    """Edges by (root, b, a) -> followers and their leaders, component by component."""
    import pyarrow as pa

    current, last, follows, done = None, None, set(), False
    for batch in batches:
        out = []
        for root, a, b in zip(*(batch[c].to_pylist() for c in ("root", "a", "b"))):
            if root != current:
                current, follows = root, set()
            if b != last:
                last, done = b, False
            if not done and a not in follows:
                follows.add(b)
                out.append((b, a))
                done = True
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["set_id", "leader"])


def _by_rounds(edges: DataFrame) -> DataFrame:
    """Edges -> followers and leaders; a round settles every node whose lesser neighbours are settled."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    state = kept(nodes.withColumn("leader", F.lit(None).cast("long")), "leaders")
    while not state.filter("leader is null").isEmpty():
        marks = state.select(F.col("set_id").alias("a"), F.col("leader").alias("of"), (F.col("leader") == F.col("set_id")).alias("leads"))
        near = edges.join(marks, "a").groupBy("b").agg(F.min(F.when(F.col("leads"), F.col("a"))).alias("first"), F.min(F.when(F.col("of").isNull(), F.col("a"))).alias("open"))
        joined = state.join(near.withColumnRenamed("b", "set_id"), "set_id", "left")
        follows = F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("first") < F.col("open")))
        settled = F.when(follows, F.col("first")).when(F.col("open").isNull(), F.col("set_id"))
        state = kept(joined.select("set_id", F.coalesce("leader", settled).alias("leader")), "leaders")
    return state.filter("leader <> set_id")


def followers(edges: DataFrame, fold: int = FOLD) -> DataFrame:
    """(a < b) edges -> (set_id, leader) of nodes that follow: the earliest neighbour that leads itself.

    A component of up to ``fold`` edges is settled in one pass by one task; larger ones in rounds.
    """
    edges = kept(edges.select("a", "b"), "edges")
    rooted = edges.join(components(edges).withColumnRenamed("node", "a"), "a")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n_edges"))
    rooted = kept(rooted.join(sizes, "root"), "rooted-edges")
    small = rooted.filter(F.col("n_edges") <= fold).select("root", "a", "b").repartition("root").sortWithinPartitions("root", "b", "a")
    found = small.mapInArrow(_folded, "set_id long, leader long")
    large = rooted.filter(F.col("n_edges") > fold).select("a", "b")
    return found if large.isEmpty() else found.unionByName(_by_rounds(large))


def _set_key() -> Column:
    return F.concat_ws(" ", F.coalesce(F.col("year").cast("string"), F.lit("-")), F.concat_ws(" ", "tokens"))


def leader_clusters(df: DataFrame, title: str, position: str, least: float = 0.70, known: DataFrame | None = None) -> DataFrame:
    """Adds ``leader``: the position of the row's leader, its own for leaders.

    A row leads if no earlier leader is similar, else it follows its earliest
    similar leader; similarity to a follower counts for nothing. Rows with equal
    tokens, year and number act as one, so pairs are of distinct sets only; rows
    without tokens lead themselves.

    ``known``: leaders (title, position) of rows settled before, all earlier than these:
    rows are settled against them and each other alone, with the result of a run over all.
    """
    rows = tokenised(df, title)
    listed = rows if known is None else rows.select(F.col(position).alias(position), "tokens", "year", "number").unionByName(tokenised(known, title).select(position, "tokens", "year", "number"))
    full = listed.filter(F.size("tokens") > 0).withColumn("key", _set_key())
    sets = full.groupBy("key", "year", "number", "tokens").agg(F.min(position).alias("set_id"))
    sets = kept(sets, "sets")
    # Known leaders are similar to no other known leader, so edges among them do not arise.
    led = followers(similar_pairs(sets.drop("key"), least))
    found = sets.select("key", "set_id").join(led, "set_id", "left").select("key", F.coalesce("leader", "set_id").alias("found"))
    out = rows.withColumn("key", F.when(F.size("tokens") > 0, _set_key())).join(found, "key", "left")
    return out.withColumn("leader", F.coalesce("found", position)).drop("found", "key", "tokens", "year", "number")


def representatives(clustered: DataFrame, url: str = "url", source: str = "source") -> DataFrame:
    """One row a cluster: open before others, then priority, then last seen; the rest as ``also_at``."""
    rank = F.struct((F.col("status") == "aberto").cast("int").alias("o"), F.coalesce("priority", F.lit(0.0)).alias("p"), F.coalesce(F.col("last_seen").cast("string"), F.lit("")).alias("l"), (-F.col("position")).alias("i"))
    every = F.struct(*[F.col(c) for c in clustered.columns])
    best = clustered.groupBy("leader").agg(F.max_by(every, rank).alias("r"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("position", source, url))), lambda s: F.struct(s[source].alias("source"), s[url].alias("url")))).alias("all"))
    return best.select("r.*", F.filter("all", lambda s: ~((s["source"] == F.col(f"r.{source}")) & (s["url"] == F.col(f"r.{url}")))).alias("also_at"))


def front(pairs: DataFrame) -> DataFrame:
    """Older editions (year, tokens, o, likeness, __rank) that are the best of those before some row: each comes before all that are better."""
    better = Window.partitionBy("year", "tokens").orderBy(F.col("likeness").desc(), F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = pairs.withColumn("__first", F.min("o").over(better))
    return first.filter(F.col("__first").isNull() | (F.col("o") < F.col("__first"))).drop("__first")


def previous_editions(new: DataFrame, known: DataFrame, title: str = "title", url: str = "url", order: str = "position", least: float = 0.75, earlier: bool = False, own: bool = False) -> DataFrame:
    """Left rows with previous_url and previous_year: the most similar older edition, first inserted on ties.

    With ``earlier`` only known rows that come before the left row by ``order`` count;
    with ``own`` the left rows are known as well.
    """
    family = signature_tokens(without_year(F.col(title)))
    side = lambda df: settled(df.select(url, order, year_of(F.col(title)).alias("year"), family.alias("tokens"))).filter(F.col("year").isNotNull() & (F.size("tokens") > 0))
    # Titles are brought to tokens once; equal (year, tokens) sets of either side meet once; members are found again by both.
    rows = kept(side(new), "dated")
    older_rows = side(known).unionByName(rows) if own else side(known)
    if rows.isEmpty() or older_rows.isEmpty():
        return new.withColumns({"previous_url": F.lit(None).cast(dict(known.dtypes)[url]), "previous_year": F.lit(None).cast("int")})
    n = rows.select("year", "tokens").distinct()
    k = older_rows.groupBy("year", "tokens").agg(F.min(F.struct(F.col(order).alias("o"), F.col(url).alias("u"))).alias("first"))
    sets = n.withColumn("asks", F.lit(True)).join(k, ["year", "tokens"], "full").withColumn("set_id", F.monotonically_increasing_id())
    sets = kept(sets.select("set_id", "year", "tokens", F.coalesce("asks", F.lit(False)).alias("asks"), "first"), "editions")
    older = F.col("x.asks") & F.col("y.first").isNotNull() & (F.col("y.year") < F.col("x.year"))
    found = similar_pairs(sets, least, (), older)
    pairs = found.join(sets.select(F.col("set_id").alias("a"), "year", "tokens"), "a").join(sets.select(F.col("set_id").alias("b"), F.col("year").alias("y"), "first.o", "first.u"), "b")
    pairs = pairs.select("year", "tokens", "y", "o", "u", F.col("similarity").alias("likeness"))
    best = F.max_by(F.struct("u", "y"), F.struct("likeness", "__rank")).alias("b")
    last = Window.partitionBy("year", "tokens").orderBy(F.col("o").desc())
    ranked = pairs.withColumn("__rank", F.row_number().over(last))
    if not earlier:
        found = ranked.groupBy("year", "tokens").agg(best)
        out = new.withColumns({"__y": year_of(F.col(title)), "__t": family}).alias("l").join(found.alias("r"), (F.col("__y") == F.col("r.year")) & (F.col("__t") == F.col("r.tokens")), "left")
        return out.select(*[F.col(f"l.`{c}`") for c in new.columns], F.col("r.b.u").alias("previous_url"), F.col("r.b.y").alias("previous_year"))
    met = rows.join(front(ranked.distinct()), ["year", "tokens"]).filter(F.col("o") < F.col(order))
    found = met.groupBy(url).agg(best)
    return new.join(found, url, "left").select(*[F.col(f"`{c}`") for c in new.columns], F.col("b.u").alias("previous_url"), F.col("b.y").alias("previous_year"))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
