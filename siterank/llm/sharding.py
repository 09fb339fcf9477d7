"""Balanced label propagation: linked documents move towards their neighbours' shards.

The links are those of equal texts.  Documents begin in random shards of equal size.  In
every round a group looks where most of its members are and those elsewhere ask to
move there.  Requests are exchanged between two shards or around a circle of shards, and
fill what room there is up to the quotas; those with the greatest gain go first.  When
nothing more can be exchanged, groups turn to shards with room.  Rounds go on until
nobody moves.  Members of a group in one shard are alike, so a round works on
one row per group and shard, however large a group is; documents without links fill
what is left of the quotas.  All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from siterank.llm.tables import unsigned_crc32
from siterank.operators.skew import running_sums, salted_join
from siterank.session import materialize


def even(total: int, shards: int) -> list[int]:
    """Sizes that add up to ``total`` and differ by at most one."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), (at + 1).cast("int"))


def by_rank(sizes: list[int], rank: Column) -> tuple[Column, Column]:
    """Shard of a rank from 1 when shards of these sizes are filled in turn, and the rank within it."""
    shard, inside, upto = F.lit(len(sizes) - 1), rank - sum(sizes[:-1]), sum(sizes[:-1])
    for s in range(len(sizes) - 2, -1, -1):
        shard, inside = F.when(rank <= upto, s).otherwise(shard), F.when(rank <= upto, rank - (upto - sizes[s])).otherwise(inside)
        upto -= sizes[s]
    return shard.cast("int"), inside.cast("long")


def loads(cells: DataFrame, shards: int) -> list[int]:
    """Rows per shard: one number each."""
    found = {r["_shard"]: r["n"] for r in cells.groupBy("_shard").agg(F.sum("_n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def admissions(asked: dict, tied: dict, free: list[int]) -> tuple[dict, dict]:
    """How many rows go from shard to shard: ``(s, t)`` to rows, of those that ask and of the tied.

    ``asked`` has rows by ``(s, t)``; ``tied`` has ``(rows, groups)`` by ``(s, t)``, s < t,
    of groups that may gather in either.  Opposite requests are exchanged, then requests
    around longer circles, then the free room is filled, and what a leaver frees as well.
    Only numbers of shards are handled here.
    """
    asked, either, free = dict(asked), {k: n for k, (n, _) in tied.items()}, list(free)
    by_asked, by_tied = {}, {}
    shards = range(len(free))

    def room(s: int, t: int) -> int:
        return asked.get((s, t), 0) + either.get((min(s, t), max(s, t)), 0) + oriented.get((s, t), 0)

    def take(s: int, t: int, n: int, kept: bool = True) -> None:
        first = min(n, asked.get((s, t), 0))
        if first:
            asked[s, t] -= first
            by_asked[s, t] = by_asked.get((s, t), 0) + first
        if n > first:
            by_tied[s, t] = by_tied.get((s, t), 0) + n - first
            pair = (min(s, t), max(s, t))
            if kept:
                # The rest of these rows may only follow, never come back.
                oriented[s, t] = oriented.get((s, t), 0) + either.pop(pair, 0)
                oriented[s, t] -= n - first
            else:
                either[pair] -= n - first

    def way(s: int, t: int) -> list[int] | None:
        """A shortest way from s to t, not along the edge itself."""
        came, turn = {s: s}, [s]
        for a in turn:
            for b in shards:
                if b not in came and {a, b} != {s, t} and room(a, b) > 0:
                    came[b] = a
                    turn.append(b)
        if t not in came:
            return None
        path = [t]
        while path[-1] != s:
            path.append(came[path[-1]])
        return path[::-1]

    oriented: dict = {}
    pairs = [(s, t) for s in shards for t in shards if s < t]
    for s, t in pairs:
        opposite = min(asked.get((s, t), 0), asked.get((t, s), 0))
        for a, b in ((s, t), (t, s)) if opposite else ():
            take(a, b, opposite)
        for a, b in ((s, t), (t, s)):
            n = min(asked.get((a, b), 0), either.get((s, t), 0))
            if n:
                take(a, b, n)
                take(b, a, n, tied[s, t][1] == 1)
        half = either.get((s, t), 0) // 2
        if half and tied[s, t][1] > 1:
            take(s, t, half, False)
            take(t, s, half, False)
    for s, t in [(s, t) for s in shards for t in shards if s != t]:
        while room(s, t) > 0 and (path := way(t, s)):
            edges = [(s, t), *zip(path, path[1:])]
            n = min(room(a, b) for a, b in edges)
            for a, b in edges:
                take(a, b, n)
    # No circles are left: room that is handed back along requests comes to an end.
    more = True
    while more:
        more = False
        for s, t in [(s, t) for s in shards for t in shards if s != t]:
            n = min(room(s, t), free[t])
            if n > 0:
                take(s, t, n)
                free[t], free[s], more = free[t] - n, free[s] + n, True
    return by_asked, by_tied


def exchange(cells: DataFrame, quotas: list[int], free: list[int]) -> DataFrame:
    """Moves ``_group, _shard, _to, _moved`` of members to where most of their group are.

    A cell that fills its shard stays.  Groups with two largest cells may gather in either.
    """
    shards = len(quotas)
    open_cells = cells.filter(F.col("_n") < pick(quotas, F.col("_shard")))
    group = Window.partitionBy("_group")
    order = group.orderBy(F.col("_n").desc(), F.xxhash64("_group", "_shard"), "_shard")
    ranked = open_cells.select(
        "_group",
        "_shard",
        "_n",
        F.row_number().over(order).alias("_nth"),
        F.first("_shard").over(order).alias("_to"),
        F.first("_n").over(order).alias("_most"),
    ).filter("_nth > 1")
    tied = (F.col("_nth") == 2) & (F.col("_n") == F.col("_most"))
    movers = ranked.select(
        "_group",
        F.when(tied, F.least("_shard", "_to")).otherwise(F.col("_shard")).alias("_shard"),
        F.when(tied, F.greatest("_shard", "_to")).otherwise(F.col("_to")).alias("_to"),
        "_n",
        (F.col("_n") - F.col("_most")).alias("_loss"),
        tied.cast("int").alias("_tied"),
    )
    movers = materialize(movers)
    # One row per pair of shards.
    sums = movers.groupBy("_tied", "_shard", "_to").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups")).collect()
    asked = {(r["_shard"], r["_to"]): r["n"] for r in sums if not r["_tied"]}
    either = {(r["_shard"], r["_to"]): (r["n"], r["groups"]) for r in sums if r["_tied"]}
    by_asked, by_tied = admissions(asked, either, free)

    def of(found: dict, back: bool = False) -> Column:
        edges = [found.get((t, s) if back else (s, t), 0) for s in range(shards) for t in range(shards)]
        return pick(edges, F.col("_shard") * shards + F.col("_to"))

    queue = running_sums(movers, ["_tied", "_shard", "_to"], ["_loss", "_group"], {"_upto": F.col("_n")})
    is_tied = F.col("_tied") == 1
    there = F.when(is_tied, of(by_tied)).otherwise(of(by_asked)) - (F.col("_upto") - F.col("_n"))
    # Of the tied the last go the other way.
    behind = of({k: n for k, (n, _) in either.items()}) - F.col("_upto")
    back = F.when(is_tied, of(by_tied, True) - behind).otherwise(F.lit(0))
    net = F.greatest(F.lit(0), F.least("_n", there)) - F.greatest(F.lit(0), F.least(F.col("_n"), back))
    moves = queue.withColumn("_net", net).filter("_net <> 0")
    return moves.select(
        "_group",
        F.when(F.col("_net") > 0, F.col("_shard")).otherwise(F.col("_to")).alias("_shard"),
        F.when(F.col("_net") > 0, F.col("_to")).otherwise(F.col("_shard")).alias("_to"),
        F.abs("_net").alias("_moved"),
    )


def fill(cells: DataFrame, free: list[int]) -> DataFrame:
    """Moves to where most neighbours are among the shards with room; at a tie the first."""
    group = Window.partitionBy("_group")
    best = F.max(F.when(pick(free, F.col("_shard")) > 0, F.struct("_n", (-F.col("_shard")).alias("_s")))).over(group)
    asked = cells.withColumn("_best", best).select(
        "_group", "_shard", "_n", F.col("_best._n").alias("_most"), (-F.col("_best._s")).cast("int").alias("_to")
    )
    nearer = (F.col("_n") <= F.col("_most")) & (F.col("_shard") != F.col("_to"))
    movers = asked.filter(nearer).withColumn("_loss", F.col("_n") - F.col("_most"))
    queue = running_sums(movers, ["_to"], ["_loss", "_group", "_shard"], {"_upto": F.col("_n")})
    room = pick(free, F.col("_to")) - (F.col("_upto") - F.col("_n"))
    moved = queue.withColumn("_moved", F.greatest(F.lit(0), F.least("_n", room))).filter("_moved > 0")
    return moved.select("_group", "_shard", "_to", "_moved")


def gather(cells: DataFrame, free: list[int]) -> DataFrame:
    """Moves of whole split groups to the roomiest shard, the smallest first, as far as they fit."""
    roomiest = max(range(len(free)), key=lambda s: free[s])
    away = F.when(F.col("_shard") != roomiest, F.col("_n")).otherwise(0)
    groups = cells.groupBy("_group").agg(F.count(F.lit(1)).alias("_cells"), F.sum(away).alias("_away"))
    groups = groups.filter((F.col("_cells") > 1) & (F.col("_away") <= free[roomiest]))
    queue = running_sums(groups, [], ["_away", "_group"], {"_upto": F.col("_away")})
    fits = queue.filter(F.col("_upto") <= free[roomiest]).select("_group")
    moved = cells.filter(F.col("_shard") != roomiest).join(fits, "_group")
    return moved.select("_group", "_shard", F.lit(roomiest).alias("_to"), F.col("_n").alias("_moved"))


def propagate(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """Cells ``_group, _shard, _n`` when nobody moves; no shard ever holds more than its quota.

    Every move makes the sum of the squares of ``_n`` greater, so the rounds end.
    """
    while True:
        free = [q - load for q, load in zip(quotas, loads(cells, len(quotas)))]
        moved = materialize(exchange(cells, quotas, free))
        for other in (fill, gather):
            if moved.isEmpty() and any(free):
                moved = materialize(other(cells, free))
        if moved.isEmpty():
            return cells
        changes = moved.select("_group", "_shard", (-F.col("_moved")).alias("_n")).unionByName(
            moved.select("_group", F.col("_to").alias("_shard"), F.col("_moved").alias("_n"))
        )
        cells = cells.unionByName(changes).groupBy("_group", "_shard").agg(F.sum("_n").alias("_n"))
        cells = materialize(cells.filter("_n > 0"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Add ``size, text_crc32, law, shard, slot, grown_shard`` to every document.

    The law is ``rows``: counts of shards are at most one apart, so ``grown_shard`` is
    null.  ``size`` is the UTF-8 bytes of the text plus 1.  Equal texts are linked, null
    counting as empty.  ``slot`` numbers the rows of a shard from 0 without a gap.  Rows
    repeat as they came, equal rows are linked as any others; columns of the added
    names are replaced, all others stay.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*[c for c in added if c in docs.columns])
    kept = [c for c in docs.columns if c != "text"]
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        *kept,
        (F.octet_length(content) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
        F.md5(content).alias("_group"),
    )
    # Written once: numbers of rows must not change between their uses.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    quotas = even(rows.count(), shards)
    counts = materialize(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_members")))
    linked_groups = counts.filter("_members > 1")
    linked = materialize(salted_join(rows, linked_groups, ["_group"], ["_row"], counts=counts, n="_members").withColumn("_mix", F.xxhash64("_row")))
    single = rows.join(counts.filter("_members = 1").select("_group"), "_group")
    begun = running_sums(linked.select("_group", "_row", "_mix"), [], ["_mix", "_row"], {"_rank": F.lit(1)})
    begun = begun.withColumn("_shard", by_rank(even(linked.count(), shards), F.col("_rank"))[0])
    cells = materialize(begun.groupBy("_group", "_shard").agg(F.count(F.lit(1)).alias("_n")))
    cells = propagate(cells, quotas)
    held = loads(cells, shards)
    # Cells follow one another in their shard, and in their group.
    cells = running_sums(cells, ["_shard"], ["_group"], {"_slots": F.col("_n")})
    within = Window.partitionBy("_group").orderBy("_shard")
    cells = cells.withColumn("_upto", F.sum("_n").over(within))
    places = cells.groupBy("_group").agg(
        F.sort_array(F.collect_list(F.struct("_upto", "_n", "_shard", "_slots"))).alias("_cells")
    )
    ranked = running_sums(linked, ["_group"], ["_row"], {"_rank": F.lit(1)})
    ranked = salted_join(ranked, materialize(places), ["_group"], ["_row"], counts=counts, n="_members")
    cell = F.filter("_cells", lambda c: c["_upto"] >= F.col("_rank"))[0]
    placed = ranked.withColumn("_cell", cell).select(
        *kept,
        "size",
        "text_crc32",
        F.col("_cell._shard").cast("int").alias("shard"),
        # The cell's last slot less those of its members that come after this one.
        (F.col("_cell._slots") - 1 - (F.col("_cell._upto") - F.col("_rank"))).cast("long").alias("slot"),
    )
    left = [q - h for q, h in zip(quotas, held)]
    filler = running_sums(single, [], ["_row"], {"_rank": F.lit(1)})
    shard, inside = by_rank(left, F.col("_rank"))
    filler = filler.select(
        *kept, "size", "text_crc32", shard.alias("shard"), (pick(held, shard) + inside - 1).cast("long").alias("slot")
    )
    every = placed.unionByName(filler)
    return every.select(
        *kept,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
