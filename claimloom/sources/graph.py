"""The evidence graph as two DataFrames, projected from star-schema tables.

Parts are startups, suppliers invest (investor, company or person by key),
customers found and are employed, orders are articles. Each relation is one
aggregation to its edge key; only those that a query names are planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.model import RELATIONS, SUPPORTED, UNSUPPORTED
from claimloom.operators.components import kept

NODE_COLUMNS = "id label name canonical_name aliases description title published_at source_name".split()
EDGE_COLUMNS = "src_id src_label rel_type dst_id dst_label evidence_status lifecycle_status review_status support articles".split()


#: Relations between parts of one order, by how many lines they are apart; relations of a line itself.
PAIRED = {"ACQUIRED": 1, "MERGED_WITH": 2, "PARTNERED_WITH": 3}
LINED = ("INVESTED_IN", "FOUNDED_BY", "EMPLOYED_BY")
CLAIMED = (*LINED, *PAIRED)
#: Line numbers that meet as one; lines of an order that are paired are in one such run or in the next.
RUN = 8
#: A line makes about seven edges, or rows that edges are made of.
LINES_A_PART = 100_000
#: Return flags in their order, as which a claim is reviewed: accepted, unreviewed, rejected.
FLAGS = ("A", "N", "R")
#: What nodes are in numbers: a number is the key, or the place of a text in a table of texts, times 8, and the place here.
KINDS = ("startup", "backer", "customer", "article", "topic", "source")
#: The number of a backer without a key, and the keys that numbers have room for.
NO_BACKER, FARTHEST = 7, (1 << 60) - 1


def place_of(column: str, values: tuple[str, ...]) -> Column:
    """A text's place among sorted values, as a number: 1, 3, ... are these, even ones lie between; greatest where the text is greatest."""
    place = F.lit(2 * len(values))
    for i, v in reversed(list(enumerate(values))):
        place = F.when(F.col(column) < v, 2 * i).when(F.col(column) == v, 2 * i + 1).otherwise(place)
    return F.when(F.col(column).isNotNull(), place)


def runs_before(number: str, steps: list[int]) -> Column:
    """The runs of RUN numbers, mostly one, that hold the numbers which are less by one of some steps."""
    least, most = min(steps), max(steps)
    return F.array_distinct(F.array(*[F.expr(f"({number} - {s}) div {RUN}") for s in (*range(least, most, RUN), most)]))


def number_of(kind: str, key: Column) -> Column:
    return F.shiftleft(key.cast("long"), 3) + F.lit(KINDS.index(kind))


class Graph:
    """Nodes and edges over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.spread = spark, sf_dir, False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _spread(self) -> None:
        """Shuffles get a partition for each LINES_A_PART lines at least, so that a task's share doesn't grow with the table. Lines are counted from the footers.

        The plan reads the setting when it runs, so it stays raised; adaptive execution joins small parts again.
        """
        if not self.spread:
            self.spread, name = True, "spark.sql.shuffle.partitions"
            parts = -(-self.table("lineitem").count() // LINES_A_PART)
            if parts > int(self.spark.conf.get(name)):
                self.spark.conf.set(name, str(parts))

    # --- nodes

    def nodes(self, *labels: str) -> DataFrame:
        """The nodes of some labels (all, if none is named), each once."""
        parts = [getattr(self, f"_{x.lower()}_nodes")() for x in labels or ("Startup", "Investor", "Company", "Person", "Topic", "Article", "Source")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _node(df: DataFrame, label: str, key: Column, name: Column | None = None, aliases: Column | None = None, description: Column | None = None, title: Column | None = None, at: Column | None = None, source: Column | None = None) -> DataFrame:
        text = F.lit(None).cast("string")
        return df.select(
            F.concat(F.lit(label.lower() + ":"), key.cast("string")).alias("id"),
            F.lit(label).alias("label"),
            (text if name is None else name).alias("name"),
            (text if name is None else name).alias("canonical_name"),
            (F.array().cast("array<string>") if aliases is None else aliases).alias("aliases"),
            (text if description is None else description).alias("description"),
            (text if title is None else title).alias("title"),
            (F.lit(None).cast("timestamp") if at is None else at.cast("timestamp")).alias("published_at"),
            (text if source is None else source).alias("source_name"),
        )

    def _startup_nodes(self) -> DataFrame:
        c = F.col
        return self._node(self.table("part"), "Startup", c("p_partkey"), c("p_name"), F.array(F.concat_ws(" ", "p_brand", "p_name")), c("p_type"))

    def _supplier_nodes(self, label: str, rest: int) -> DataFrame:
        return self._node(self.table("supplier").where(F.col("s_suppkey") % 3 == rest), label, F.col("s_suppkey"), F.col("s_name"))

    def _investor_nodes(self) -> DataFrame:
        return self._supplier_nodes("Investor", 0)

    def _company_nodes(self) -> DataFrame:
        return self._supplier_nodes("Company", 1)

    def _person_nodes(self) -> DataFrame:
        founders = self._node(self.table("customer"), "Person", F.concat(F.lit("c"), F.col("c_custkey")), F.col("c_name"), description=F.col("c_mktsegment"))
        return self._supplier_nodes("Person", 2).unionByName(founders)

    def _topic_nodes(self) -> DataFrame:
        return self._node(self.table("part").select("p_brand").distinct(), "Topic", F.col("p_brand"), F.col("p_brand"))

    def _article_nodes(self) -> DataFrame:
        c = F.col
        return self._node(self.table("orders"), "Article", c("o_orderkey"), title=F.concat(F.lit("Order "), c("o_orderkey").cast("string")), at=c("o_orderdate"), source=c("o_orderpriority"))

    def _source_nodes(self) -> DataFrame:
        return self._node(self.table("orders").select("o_orderpriority").distinct(), "Source", F.col("o_orderpriority"), F.col("o_orderpriority"))

    # --- edges

    def edges(self, *relations: str, articles: bool = False) -> DataFrame:
        """The edges of some relations (all, if none is named), one per source, relation and target.

        articles: also gather the ids of the articles behind each claim. All
        claims that lines make are brought to their keys by one aggregation.
        """
        self._spread()
        wanted = relations or RELATIONS
        parts = [self._claims(wanted, articles)] if set(wanted) & {*PAIRED, *LINED} else []
        parts += [getattr(self, f"_{r.lower()}")() for r in ("HAS_TOPIC", "MENTIONS", "FROM_SOURCE") if r in wanted]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _startup(key: str) -> Column:
        return F.concat(F.lit("startup:"), F.col(key).cast("string"))

    @staticmethod
    def _backer(key: str) -> Column:
        label = F.when(F.col(key) % 3 == 0, "investor").when(F.col(key) % 3 == 1, "company").otherwise("person")
        return F.concat_ws(":", label, F.col(key).cast("string"))

    @staticmethod
    def _edge(df: DataFrame, rel: Column, evidence: Column, lifecycle: Column, review: Column) -> DataFrame:
        label = lambda c: F.initcap(F.substring_index(c, ":", 1))
        for c in ("support", "articles"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(1).cast("long") if c == "support" else F.lit(None).cast("array<string>"))
        return df.select("src_id", label("src_id").alias("src_label"), rel.alias("rel_type"), "dst_id", label("dst_id").alias("dst_label"), evidence.alias("evidence_status"), lifecycle.alias("lifecycle_status"), review.alias("review_status"), "support", "articles")

    def _lines(self) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")

    def links(self) -> DataFrame:
        """(src_id, dst_id) of all edges as their rows stand, not made one per edge: for questions of who is linked to whom."""
        self._spread()
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        part = self.table("part").select("p_partkey", F.concat(F.lit("topic:"), F.col("p_brand")).alias("topic"))
        article = F.concat(F.lit("article:"), F.col("l_orderkey").cast("string"))
        mentions = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(article.alias("src_id"), F.explode(F.array(self._startup("l_partkey"), F.col("topic"))).alias("dst_id")).where("dst_id is not null")
        parts = [self._named(self._claim_keys(RELATIONS)).select("src_id", "dst_id"), mentions, part.select(self._startup("p_partkey").alias("src_id"), F.col("topic").alias("dst_id")), self._from_source().select("src_id", "dst_id")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def numbers_fit(self) -> bool:
        """Whether all keys of links have numbers. Row groups whose bounds say so aren't read."""
        for name, keys in (("part", ("p_partkey",)), ("orders", ("o_orderkey", "o_custkey")), ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey"))):
            if not self.table(name).where(" or ".join(f"{k} < -{FARTHEST} or {k} > {FARTHEST}" for k in keys)).isEmpty():
                return False
        return True

    def numbered_links(self) -> tuple[DataFrame, DataFrame]:
        """links() with numbers for ids, and the table of texts (number, text) in which topics and sources have theirs. Ask numbers_fit() first."""
        self._spread()
        topic, source = F.concat(F.lit("topic:"), F.col("p_brand")), F.concat(F.lit("source:"), F.col("o_orderpriority"))
        told = self.table("part").select(F.lit("topic").alias("kind"), topic.alias("text")).unionByName(self.table("orders").select(F.lit("source").alias("kind"), source.alias("text"))).where("text is not null").distinct()
        place = F.monotonically_increasing_id()
        texts = kept(told.select(F.when(F.col("kind") == "topic", number_of("topic", place)).otherwise(number_of("source", place)).alias("number"), "text"))
        backer = lambda c: F.coalesce(number_of("backer", F.col(c)), F.lit(NO_BACKER).cast("long"))
        kind = lambda *rs: F.col("rel").isin(*[CLAIMED.index(r) for r in rs])
        startup = lambda c: number_of("startup", F.col(c))
        claims = self._claim_keys(RELATIONS).select(
            F.when(kind("INVESTED_IN"), backer("x")).when(kind("EMPLOYED_BY"), number_of("customer", F.col("x"))).otherwise(startup("x")).alias("src_id"),
            F.when(kind("FOUNDED_BY"), number_of("customer", F.col("y"))).when(kind("EMPLOYED_BY"), backer("y")).otherwise(startup("y")).alias("dst_id"),
        )
        part = self.table("part").select("p_partkey", topic.alias("named")).join(texts, F.col("named") == F.col("text")).select("p_partkey", F.col("number").alias("topic"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        mentions = lines.select(number_of("article", F.col("l_orderkey")).alias("src_id"), F.explode(F.array(startup("l_partkey"), F.col("topic"))).alias("dst_id"))
        own = part.select(startup("p_partkey").alias("src_id"), F.col("topic").alias("dst_id"))
        told_by = self.table("orders").select("o_orderkey", source.alias("named")).join(texts, F.col("named") == F.col("text")).select(number_of("article", F.col("o_orderkey")).alias("src_id"), F.col("number").alias("dst_id"))
        return claims.unionByName(mentions).unionByName(own).unionByName(told_by), texts

    def with_ids(self, numbered: DataFrame, texts: DataFrame) -> DataFrame:
        """numbered (id, a number, and other columns) with ids as texts. texts: those of numbered_links()."""
        key = F.shiftright("id", 3)
        is_a = lambda kind: F.col("id").bitwiseAND(F.lit(7)) == F.lit(KINDS.index(kind))
        numbered = numbered.join(texts, F.col("id") == F.col("number"), "left").withColumn("key", F.when(F.col("id") != NO_BACKER, key))
        text = F.when(is_a("startup"), self._startup("key")).when(is_a("customer"), F.concat(F.lit("person:c"), F.col("key").cast("string"))).when(is_a("article"), F.concat(F.lit("article:"), F.col("key").cast("string")))
        return numbered.withColumn("id", F.coalesce("text", text.otherwise(self._backer("key")))).drop("number", "text", "key")

    def _claim_keys(self, wanted: tuple[str, ...]) -> DataFrame:
        """A row for each line or pair of lines that makes a claim, in numbers: rel (its place in CLAIMED) and the keys x and y of its ends, flag and status as ranks."""
        facts = ["l_orderkey", place_of("l_returnflag", FLAGS).alias("flag"), place_of("l_linestatus", ("O",)).alias("status")]
        key = lambda c: F.col(c).cast("long")
        rel = lambda r: F.lit(CLAIMED.index(r))
        rows = []
        if "INVESTED_IN" in wanted:
            rows.append(self._lines().select(*facts, rel("INVESTED_IN").alias("rel"), key("l_suppkey").alias("x"), key("l_partkey").alias("y")))
        numbers = [n for r, n in (("FOUNDED_BY", 1), ("EMPLOYED_BY", 6)) if r in wanted]
        if numbers:
            orders = self.table("orders").select(F.col("o_orderkey").alias("o"), key("o_custkey").alias("who"))
            lines = self._lines().where(F.col("l_linenumber").isin(numbers)).join(orders, F.col("l_orderkey") == F.col("o"))
            founded = F.col("l_linenumber") == 1
            rows.append(lines.select(*facts, F.when(founded, rel("FOUNDED_BY")).otherwise(rel("EMPLOYED_BY")).alias("rel"), F.when(founded, key("l_partkey")).otherwise(F.col("who")).alias("x"), F.when(founded, F.col("who")).otherwise(key("l_suppkey")).alias("y")))
        steps = [k for r, k in PAIRED.items() if r in wanted]
        if steps:
            # lines of an order some numbers apart, all distances in one join; the flags are the earlier line's. A line is sent once, not for each distance
            first = self._lines().select(*facts, "l_linenumber", key("l_partkey").alias("x"), F.expr(f"l_linenumber div {RUN}").alias("run"))
            second = self._lines().select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), key("l_partkey").alias("y"), F.explode(runs_before("l_linenumber", steps)).alias("of_run"))
            met = (F.col("l_orderkey") == F.col("o")) & (F.col("run") == F.col("of_run")) & (F.col("n") - F.col("l_linenumber")).isin(steps)
            pairs = first.join(second, met).where("x <> y").withColumn("step", F.col("n") - F.col("l_linenumber"))
            merger = F.col("step") == PAIRED["MERGED_WITH"]
            kind = F.when(F.col("step") == PAIRED["ACQUIRED"], rel("ACQUIRED")).when(merger, rel("MERGED_WITH")).otherwise(rel("PARTNERED_WITH"))
            rows.append(pairs.select("l_orderkey", "flag", "status", kind.alias("rel"), F.when(merger, F.least("x", "y")).otherwise(F.col("x")).alias("x"), F.when(merger, F.greatest("x", "y")).otherwise(F.col("y")).alias("y")))
        lines = rows[0]
        for r in rows[1:]:
            lines = lines.unionByName(r)
        return lines

    def _named(self, rows: DataFrame) -> DataFrame:
        """rows with src_id, rel_type and dst_id for rel, x and y. Of a merger the end is first whose id is less as text."""
        kind = lambda *rs: F.col("rel").isin(*[CLAIMED.index(r) for r in rs])
        person = lambda c: F.concat(F.lit("person:c"), F.col(c).cast("string"))
        x, y = self._startup("x"), self._startup("y")
        return rows.select(
            "*",
            F.when(kind("INVESTED_IN"), self._backer("x")).when(kind("EMPLOYED_BY"), person("x")).when(kind("MERGED_WITH"), F.least(x, y)).otherwise(x).alias("src_id"),
            F.element_at(F.array(*map(F.lit, CLAIMED)), F.col("rel") + 1).alias("rel_type"),
            F.when(kind("FOUNDED_BY"), person("y")).when(kind("EMPLOYED_BY"), self._backer("y")).when(kind("MERGED_WITH"), F.greatest(x, y)).otherwise(y).alias("dst_id"),
        )

    def _claims(self, wanted: tuple[str, ...], articles: bool) -> DataFrame:
        # numbers alone are grouped, which takes a hash table of fixed-width rows; their ids are written after that
        gathered = [F.array_sort(F.collect_set(F.concat(F.lit("article:"), F.col("l_orderkey").cast("string")))).alias("articles")] if articles else []
        grouped = self._claim_keys(wanted).groupBy("rel", "x", "y").agg(F.max("flag").alias("flag"), F.max("status").alias("status"), F.count("*").alias("support"), *gathered)
        review = F.when(F.col("flag") == 1, "accepted").when(F.col("flag") == 3, "unreviewed").when(F.col("flag") == 5, "rejected")
        return self._edge(self._named(grouped), F.col("rel_type"), F.lit("stated"), F.when(F.col("status") == 1, SUPPORTED).otherwise(UNSUPPORTED), review)

    def _has_topic(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_brand")
        topic = F.concat(F.lit("topic:"), F.col("p_brand")).alias("dst_id")
        own = part.select(self._startup("p_partkey").alias("src_id"), topic)
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        told = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
        of_articles = told.select(F.concat(F.lit("article:"), F.col("l_orderkey").cast("string")).alias("src_id"), topic)
        return self._edge(own.unionByName(of_articles), F.lit("HAS_TOPIC"), F.lit("stated"), F.lit(SUPPORTED), F.lit("unreviewed"))

    def mentions_by(self, articles: DataFrame) -> DataFrame:
        """MENTIONS edges of some articles (id) only; the lines of others are left out before anything is grouped."""
        orders = articles.select(F.substring_index("id", ":", -1).cast("long").alias("o"))
        return self._mentions(self._lines().join(orders, F.col("l_orderkey") == F.col("o"), "left_semi"))

    def _mentions(self, lines: DataFrame | None = None) -> DataFrame:
        # by the tables' own keys: lines that are dealt by their order needn't be dealt again
        lines = self._lines() if lines is None else lines
        grouped = lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.max(place_of("l_linestatus", ("O",))).alias("status"))
        named = grouped.select("line", "status", F.concat(F.lit("article:"), F.col("l_orderkey").cast("string")).alias("src_id"), self._startup("l_partkey").alias("dst_id"))
        evidence = F.when(F.col("line") == 6, "unsure").when(F.col("status") == 1, "stated").otherwise("attributed")
        none = F.lit(None).cast("string")
        return self._edge(named, F.lit("MENTIONS"), evidence, none, none)

    def _from_source(self) -> DataFrame:
        orders = self.table("orders").select(F.concat(F.lit("article:"), F.col("o_orderkey").cast("string")).alias("src_id"), F.concat(F.lit("source:"), F.col("o_orderpriority")).alias("dst_id"))
        return self._edge(orders, F.lit("FROM_SOURCE"), F.lit("stated"), F.lit(SUPPORTED), F.lit("unreviewed"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, rel_type): every edge seen from both of its ends."""
    return edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "rel_type").unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "rel_type"))

