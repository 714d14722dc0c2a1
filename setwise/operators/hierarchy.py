"""Parent links to full hierarchies by heavy-path decomposition (problem 3).

Every loop runs a number of rounds logarithmic in the depth (pointer doubling) or
in the number of nodes (light edges), never one round a level. Each round writes a
staged table and goes on with the nodes that aren't finished; what is finished
leaves the loop. A node that is the parent of any share of the rows is joined by
scale.skew_join and otherwise only aggregated over.

1. doubling of ancestor pointers, summing subtree sizes on the way; what is still
   running when no further pointer ends lies on or below a circle;
2. the heavy child of a node is the one with the largest subtree; heavy edges
   form chains; doubling along them gives each node its chain and position;
3. every chain hangs from one node of another chain; a path to the root crosses at
   most log2(n) chains, so it is kept as that many segments (chain, upto).

A path as text is the concatenation of its chain segments; the descendants of a node
are chain intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import BROADCAST_BYTES, BROADCAST_ROWS, discard, measure, skew_join, stage

_SEGS = "array<struct<chain:string,upto:bigint>>"


@dataclass
class Hierarchy:
    """nodes: (node, parent, status, root, depth, size, chain, pos, carried columns); status is 'ok', 'circle' or 'below'.

    For 'circle' and 'below' root is '', depth -1 or -2, and size, chain and pos are null.
    chains: (chain, up_segments): the segments from the root down to the node that the chain hangs from.
    """

    nodes: DataFrame
    chains: DataFrame

    def segments(self) -> DataFrame:
        """(node, segments): the path from the root to the node as chain segments, at most log2(n) of them."""
        ok = self.nodes.where("status = 'ok'").select("node", "chain", "pos")
        own = F.array(F.struct(F.col("chain").alias("chain"), F.col("pos").alias("upto"))).cast(_SEGS)
        return skew_join(ok, self.chains, ["chain"], "inner").select("node", F.concat("up_segments", own).alias("segments"))

    def path_text(self, sep: str = "/", label: str = "node") -> DataFrame:
        """(node, path): the labels of the nodes from the root down to each node, as text.

        The members of each chain are gathered once, as an array in their order, no longer
        than the path of the chain's last node, which is one value of the result. The
        segments that lead to a chain are cut from these arrays and put before its own;
        each member's path is then a slice of that one array.
        """
        ok = self.nodes.where("status = 'ok'")
        member = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(label).alias("at"), F.col("node").alias("node")))), lambda m: F.struct(m["node"].alias("node"), m["at"].alias("at")))
        own = stage(ok.groupBy("chain").agg(member.alias("own")), "members")
        parts = self.chains.select(F.col("chain").alias("sub"), F.posexplode("up_segments").alias("no", "s")).select("sub", "no", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
        cut = skew_join(parts, own, ["chain"], "inner").select("sub", "no", F.transform(F.slice("own", F.lit(1), (F.col("upto") + 1).cast("int")), lambda m: m["at"]).alias("part"))
        above = cut.groupBy(F.col("sub").alias("chain")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "part"))), lambda p: p["part"])).alias("above"))
        whole = own.join(above, "chain", "left").select("own", F.concat(F.coalesce("above", F.array().cast("array<string>")), F.transform("own", lambda m: m["at"])).alias("labels"), F.coalesce(F.size("above"), F.lit(0)).alias("skip"))
        each = whole.select("labels", "skip", F.posexplode("own").alias("i", "m"))
        return each.select(F.col("m.node").alias("node"), F.array_join(F.slice("labels", F.lit(1), F.greatest("skip", F.lit(0)) + F.col("i") + 1), sep).alias("path"))

    def descendant_intervals(self, of: DataFrame) -> DataFrame:
        """(node, chain, lo): all descendants of the given nodes as chain intervals - the members of chain from position lo on.

        A node's own chain below it, and every chain whose path to the root leaves the
        node's chain at or below the node.
        """
        start = of.select("node").distinct().join(self.nodes.where("status = 'ok'").select("node", "chain", "pos"), "node")
        own = start.select("node", "chain", (F.col("pos") + 1).alias("lo"))
        hung = self.chains.select(F.col("chain").alias("sub"), F.explode("up_segments").alias("s")).select("sub", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
        below = skew_join(hung, start, ["chain"], "inner").where("upto >= pos").select("node", F.col("sub").alias("chain"), F.lit(0).cast("bigint").alias("lo"))
        return own.unionByName(below)

    def descendants(self, of: DataFrame) -> DataFrame:
        """(node, descendant) of the given nodes; its size is that of the result."""
        member = self.nodes.where("status = 'ok'").select("chain", "pos", F.col("node").alias("descendant"))
        return skew_join(self.descendant_intervals(of), member, ["chain"], "inner").where("pos >= lo").select("node", "descendant")


def _fits(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def build_hierarchy(links: DataFrame, carry: list[str] | None = None) -> Hierarchy:
    """The forest of links(node string, parent string). carry: further columns of links of which each node gets the least value.

    Defined cases: a null node is left out; several rows of a node count as one,
    with the least of its non-null parents; a null parent, the node itself or a
    parent that is no node makes the node a root. An empty table gives empty results.
    """
    carry = carry or []
    nodes = links.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), *[F.min(c).alias(f"_c_{c}") for c in carry])
    nodes = stage(nodes, "nodes")
    named = nodes.where("parent is not null and parent <> node").select("node", "parent")
    linked = skew_join(named, nodes.select(F.col("node").alias("parent")), ["parent"], "inner")
    base = stage(nodes.drop("parent").join(linked, "node", "left"), "base")
    discard(nodes)

    sizes, endless = _double_up(base)
    circle = _circle(endless)
    sizes = stage(sizes.join(base.select("node", "parent"), "node"), "sizes")
    chained = _chains(sizes)
    chains = _chain_segments(sizes, chained)
    up = F.aggregate("up_segments", F.lit(0).cast("bigint"), lambda a, s: a + s["upto"] + 1)
    head = chains.select("chain", up.alias("above"), F.when(F.size("up_segments") > 0, F.get("up_segments", F.lit(0))["chain"]).otherwise(F.col("chain")).alias("root"))
    carried = [F.col(f"_c_{c}").alias(c) for c in carry]
    ok = skew_join(sizes.select("node", "size").join(chained, "node"), head, ["chain"], "inner")
    ok = ok.join(base, "node").select("node", "parent", F.lit("ok").alias("status"), "root", (F.col("above") + F.col("pos")).cast("int").alias("depth"), "size", "chain", "pos", *carried)
    none = F.lit(None)
    lost = (
        base.join(endless.select("node"), "node")
        .join(circle.withColumn("on", F.lit(True)), "node", "left")
        .select(
            "node",
            "parent",
            F.when(F.col("on"), "circle").otherwise("below").alias("status"),
            F.lit("").alias("root"),
            F.when(F.col("on"), -1).otherwise(-2).cast("int").alias("depth"),
            none.cast("bigint").alias("size"),
            none.cast("string").alias("chain"),
            none.cast("bigint").alias("pos"),
            *carried,
        )
    )
    return Hierarchy(stage(ok.unionByName(lost), "forest"), chains)


def _double_up(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, size) of the nodes whose pointers end, (node, anc) of those whose never do).

    After round k, anc is the 2^k-th ancestor of a running node, and what it has
    gathered is the number of nodes less than 2^k levels below it. A node leaves the
    loop when its pointer ends; what later rounds add to it is kept as further parts of
    its size, which are summed once. If no pointer ends in a round none will: an
    acyclic node at depth 2^(k+1) or more has an ancestor that ends in that round.
    """
    one = F.lit(1).cast("bigint")
    parts = base.where("parent is null").select("node", one.alias("size"))
    running = base.where("parent is not null").select("node", F.col("parent").alias("anc"), one.alias("size"))
    many, size = measure(running)
    while many:
        ahead = running.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        moved = skew_join(running, ahead, ["anc"], "left", fits=_fits(many, size)).select("node", "anc2", "size")
        add = running.groupBy("anc").agg(F.sum("size").alias("size")).select(F.col("anc").alias("node"), F.lit(None).cast("string").alias("anc2"), "size")
        nxt = stage(moved.unionByName(add).groupBy("node").agg(F.max("anc2").alias("anc"), F.sum("size").alias("size")), "up")
        parts = parts.unionByName(nxt.where("anc is null").select("node", "size"))
        running, before = nxt.where("anc is not null"), many
        many, size = measure(running)
        if many == before:
            break
    return stage(parts.groupBy("node").agg(F.sum("size").alias("size")), "subtrees"), running.select("node", "anc")


def _circle(endless: DataFrame) -> DataFrame:
    """(node) on a circle. The nodes that are reached after 2^k steps shrink to the circles and then stay as many."""
    cur = stage(endless.select("node", "anc"), "circle")
    many = cur.select("anc").distinct().count()
    while many:
        ahead = cur.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        nxt = stage(skew_join(cur, ahead, ["anc"], "inner").select("node", F.col("anc2").alias("anc")), "circle")
        discard(cur)
        cur = nxt
        now = cur.select("anc").distinct().count()
        if now == many:
            break
        many = now
    return cur.select(F.col("anc").alias("node")).distinct()


def _chains(sizes: DataFrame) -> DataFrame:
    """(node, chain, pos): the head of the node's heavy chain and the steps to it. Nodes that have reached it leave the loop."""
    heavy = sizes.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "node"))["node"].alias("node"))
    start = stage(sizes.select("node").join(heavy, "node", "left").select("node", F.col("parent").alias("at")), "heavy")
    zero = F.lit(0).cast("bigint")
    done = start.where("at is null").select("node", F.col("node").alias("chain"), zero.alias("pos"))
    running = start.where("at is not null").select("node", "at", F.lit(1).cast("bigint").alias("pos"))
    (total, total_size), many = measure(start), running.count()
    while many:
        # Where a node's pointer has led so far: to its head (last), or to a node that runs itself.
        target = done.select(F.col("node").alias("at"), F.col("chain").alias("at2"), F.col("pos").alias("pos2"), F.lit(True).alias("last"))
        target = target.unionByName(running.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("pos").alias("pos2"), F.lit(False).alias("last")))
        nxt = stage(skew_join(running, target, ["at"], "inner", fits=_fits(total, 2 * total_size)).select("node", F.col("at2").alias("at"), (F.col("pos") + F.col("pos2")).alias("pos"), "last"), "chain")
        done = done.unionByName(nxt.where("last").select("node", F.col("at").alias("chain"), "pos"))
        running = nxt.where("not last").select("node", "at", "pos")
        many = running.count()
    return done


def _chain_segments(sizes: DataFrame, chained: DataFrame) -> DataFrame:
    """(chain, up_segments) for every chain, by doubling over the tree of chains; chains whose segments are whole leave the loop."""
    heads = chained.where("pos = 0").select(F.col("node").alias("chain"))
    links = heads.join(sizes.select(F.col("node").alias("chain"), "parent"), "chain")
    at = chained.select(F.col("node").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("upto"))
    hung = skew_join(links.where("parent is not null"), at, ["parent"], "inner")
    own = F.array(F.struct(F.col("up").alias("chain"), F.col("upto").alias("upto"))).cast(_SEGS)
    running = stage(hung.select("chain", "up", own.alias("up_segments")), "segments")
    done = links.where("parent is null").select("chain", F.array().cast(_SEGS).alias("up_segments"))
    many = running.count()
    while many:
        above = done.select(F.col("chain").alias("up"), F.lit(None).cast("string").alias("up2"), F.col("up_segments").alias("more"))
        above = above.unionByName(running.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("up_segments").alias("more")))
        nxt = stage(skew_join(running, above, ["up"], "inner").select("chain", F.col("up2").alias("up"), F.concat("more", "up_segments").alias("up_segments")), "segments")
        done = done.unionByName(nxt.where("up is null").select("chain", "up_segments"))
        running = nxt.where("up is not null")
        many = running.count()
    return stage(done, "chains")


def key_and_account_links(api_keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """(entity, node_id, node, parent): both tables' records as one forest.

    API keys compare trimmed and in lower case, account ids as numbers. A blank or
    '(undefined)' parent is none. Of repeated rows node_id is the least way of writing.
    """
    from ..scale import key_text

    ref = lambda c: F.when((key_text(F.col(c)) != "") & (key_text(F.col(c)) != "(undefined)"), key_text(F.col(c)))
    number = lambda c: ref(c).try_cast("decimal(38,0)").cast("string")
    keys = api_keys.select(F.lit("api_key").alias("entity"), F.col("api_key").alias("node_id"), F.concat(F.lit("k"), key_text(F.col("api_key"))).alias("node"), F.concat(F.lit("k"), ref("issuer_key")).alias("parent"))
    accs = accounts.select(F.lit("account").alias("entity"), F.col("account_id").alias("node_id"), F.concat(F.lit("a"), F.coalesce(number("account_id"), key_text(F.col("account_id")))).alias("node"), F.concat(F.lit("a"), number("parent_id")).alias("parent"))
    return keys.unionByName(accs)


def key_and_account_hierarchy(api_keys: DataFrame, accounts: DataFrame) -> Hierarchy:
    """The forest of both tables; its nodes carry entity and node_id."""
    return build_hierarchy(key_and_account_links(api_keys, accounts), ["entity", "node_id"])


def hierarchy_rows(api_keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """(entity, node_id, root_id, depth) of every API key and account."""
    nodes = key_and_account_hierarchy(api_keys, accounts).nodes
    root = nodes.where("depth = 0").select(F.col("node").alias("root"), F.col("node_id").alias("root_id"))
    return skew_join(nodes.select("entity", "node_id", "root", "depth"), root, ["root"], "left").select("entity", "node_id", F.coalesce("root_id", F.lit("")).alias("root_id"), "depth")


def descendant_rows(api_keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """(entity, node_id, descendant_id) of every API key and account in a tree, by chain intervals."""
    forest = key_and_account_hierarchy(api_keys, accounts)
    name = forest.nodes.where("status = 'ok'").select("node", "entity", "node_id")
    pairs = forest.descendants(name).join(name.select(F.col("node").alias("descendant"), F.col("node_id").alias("descendant_id")), "descendant")
    return skew_join(pairs, name, ["node"], "inner").select("entity", "node_id", "descendant_id")


def path_rows(api_keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """(entity, node_id, path, descendants) of every API key and account in a tree: record ids from the root down, number of descendants."""
    forest = key_and_account_hierarchy(api_keys, accounts)
    named = forest.nodes.where("status = 'ok'").select("node", "entity", "node_id", (F.col("size") - 1).alias("descendants"))
    return forest.path_text(label="node_id").join(named, "node").select("entity", "node_id", "path", "descendants")
