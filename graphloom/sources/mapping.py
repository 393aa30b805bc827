"""The driver's relational tables as a knowledge graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import conform

#: A kind's ordinal is in the bits from 48 on, so that keys up to 2**48 stay apart and ids are exact in JSON readers.
STRIDE = 1 << 48
ORDINALS = {"region": 0, "nation": 1, "customer": 2, "supplier": 3, "part": 4, "order": 5, "item": 6, "document": 7, "user": 8}
REL_TYPES = ("contains", "located_in", "next_item", "part_of", "placed_by", "supplied_by")
NOW = 1_706_745_600
EPOCH = 1_704_067_200


def gid(kind: str, key: Column | str) -> Column:
    """The graph id of a source key; a key that doesn't fit is an error, not another entity's id."""
    key = (F.col(key) if isinstance(key, str) else key).cast("long")
    fits = F.when((key >= 0) & (key < STRIDE - 1), key).when(key.isNotNull(), F.raise_error(F.lit(f"{kind} key out of range")).cast("long"))
    return fits + F.lit(ORDINALS[kind] * STRIDE + 1)


def rel_id(rel_type: str, key: Column) -> Column:
    """A stateless relation id: the type in the bits from 60 on, then a key of its own below 2**60; no global numbering is needed."""
    key = key.cast("long")
    fits = F.when((key >= 0) & (key < 1 << 60), key).otherwise(F.raise_error(F.lit(f"{rel_type} key out of range")).cast("long"))
    return F.lit(REL_TYPES.index(rel_type) << 60) + fits


def _pair(high: Column, low: Column, bits: int = 28) -> Column:
    """Two keys in one; out of range for rel_id if the low one has more bits."""
    low = low.cast("long")
    return F.when((low >= 0) & (low < 1 << bits), F.shiftleft(high.cast("long"), bits) + low).otherwise(F.lit(-1).cast("long"))


@dataclass
class Source:
    """Tables of one directory, read when asked for."""

    spark: SparkSession
    sf_dir: str
    _seen: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entities(self, *kinds: str) -> DataFrame:
        """kg_entities of the given kinds; all of them, by default, are kept for the session once computed."""
        if not kinds:
            if "entities" not in self._seen:
                self._seen["entities"] = self.entities(*ORDINALS).persist()
            return self._seen["entities"]
        parts = [getattr(self, f"_{k}")() for k in (kinds or ORDINALS)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _entity(self, df: DataFrame, kind: str, key: str, name: Column, props: dict[str, Column], created=None, **more: Column) -> DataFrame:
        cols = [gid(kind, key).alias("id"), F.lit(kind).alias("entity_type"), name.alias("name")]
        bag = F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in sorted(props.items())])) if props else F.lit("{}")
        when = F.lit(EPOCH) if created is None else created
        cols += [bag.alias("properties"), when.cast("long").alias("created_at"), when.cast("long").alias("updated_at")]
        cols += [c.alias(k) for k, c in more.items()]
        return conform(df.select(cols), "kg_entities")

    def _region(self):
        return self._entity(self.table("region"), "region", "r_regionkey", F.col("r_name"), {})

    def _nation(self):
        return self._entity(self.table("nation"), "nation", "n_nationkey", F.col("n_name"), {})

    def _customer(self):
        return self._entity(self.table("customer"), "customer", "c_custkey", F.col("c_name"), {"segment": F.col("c_mktsegment"), "acctbal": F.format_string("%.2f", "c_acctbal")})

    def _supplier(self):
        return self._entity(self.table("supplier"), "supplier", "s_suppkey", F.col("s_name"), {"acctbal": F.format_string("%.2f", "s_acctbal")})

    def _part(self):
        return self._entity(self.table("part"), "part", "p_partkey", F.col("p_name"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")})

    def _order(self):
        key = F.col("o_orderkey")
        validity = (F.when(key % 2 == 0, 1).otherwise(0) + F.when(key % 3 == 0, 2).otherwise(0)).cast("long")
        return self._entity(
            self.table("orders"), "order", "o_orderkey", F.concat(F.lit("Order#"), key.cast("string")), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")},
            created=F.unix_timestamp("o_orderdate"), validity=F.when(validity != 0, validity),
        )

    def _item(self):
        return self._entity(self.table("embeddings"), "item", "vec_id", F.concat(F.lit("item_"), F.col("vec_id").cast("string")), {"label": F.col("label")})

    def _document(self):
        return self._entity(self.table("documents"), "document", "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), {"lang": F.col("lang"), "source": F.col("source")})

    def _user(self):
        seen = F.col("event_type").isin("view", "click")
        users = self.table("events").groupBy("user_id").agg(
            F.count_if(seen).cast("long").alias("access_count"), F.max(F.when(seen, F.unix_timestamp("ts"))).alias("last_accessed"), F.min(F.unix_timestamp("ts")).alias("first_seen")
        )
        return self._entity(users, "user", "user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")), {}, created=F.col("first_seen"), access_count=F.col("access_count"), last_accessed=F.col("last_accessed"))

    def relations(self, *rel_types: str) -> DataFrame:
        """kg_relations of the given types; all of them, by default, are kept for the session once computed."""
        if not rel_types:
            if "relations" not in self._seen:
                self._seen["relations"] = self.relations(*REL_TYPES).persist()
            return self._seen["relations"]
        parts = [getattr(self, f"_{k}")() for k in (rel_types or REL_TYPES)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def fresh(self) -> tuple[DataFrame, DataFrame]:
        """All entities and relations, not kept: what a query doesn't need of them, columns or rows, is not computed."""
        return self.entities(*ORDINALS), self.relations(*REL_TYPES)

    def _relation(self, df: DataFrame, rel_type: str, key: Column, source: Column, target: Column, weight: Column, **more: Column) -> DataFrame:
        rows = df.select(rel_id(rel_type, key).alias("id"), source.alias("source_id"), target.alias("target_id"), weight.cast("double").alias("weight"), *[c.alias(k) for k, c in more.items()])
        rows = rows.withColumns({"rel_type": F.lit(rel_type), "properties": F.lit("{}"), "created_at": F.lit(EPOCH)})
        return conform(rows, "kg_relations")

    def _part_of(self):
        return self._relation(self.table("nation"), "part_of", F.col("n_nationkey"), gid("nation", "n_nationkey"), gid("region", "n_regionkey"), F.lit(1.0))

    def _located_in(self):
        c = self._relation(self.table("customer"), "located_in", 2 * F.col("c_custkey").cast("long"), gid("customer", "c_custkey"), gid("nation", "c_nationkey"), F.lit(1.0))
        s = self._relation(self.table("supplier"), "located_in", 2 * F.col("s_suppkey").cast("long") + 1, gid("supplier", "s_suppkey"), gid("nation", "s_nationkey"), F.lit(1.0))
        return c.unionByName(s)

    def _placed_by(self):
        key = F.col("o_orderkey")
        validity = (F.when(key % 2 == 0, 1).otherwise(0) + F.when(key % 3 == 0, 2).otherwise(0)).cast("long")
        return self._relation(self.table("orders"), "placed_by", key, gid("order", "o_orderkey"), gid("customer", "o_custkey"), F.lit(1.0), validity=F.when(validity != 0, validity))

    def _contains(self):
        lines = self.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.round(F.avg("l_quantity") / 50, 6).alias("w"), F.min("l_linenumber").alias("line"))
        return self._relation(lines, "contains", _pair(F.col("l_orderkey"), F.col("line"), 12), gid("order", "l_orderkey"), gid("part", "l_partkey"), F.col("w"))

    def _supplied_by(self):
        lines = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(1 - (F.avg("l_discount") + 0.0), 6).alias("w"))
        return self._relation(lines, "supplied_by", _pair(F.col("l_partkey"), F.col("l_suppkey")), gid("part", "l_partkey"), gid("supplier", "l_suppkey"), F.col("w"))

    def _next_item(self):
        items = self.table("embeddings").select(F.col("vec_id").cast("long").alias("v"))
        n = items.count()
        rows = items.withColumn("t", (F.col("v") * 7 + 3) % F.lit(max(n, 1))).where("v <> t")
        return self._relation(rows, "next_item", F.col("v"), gid("item", "v"), gid("item", "t"), F.lit(0.5))

    def vectors(self) -> DataFrame:
        e = self.table("embeddings")
        return conform(e.select(gid("item", "vec_id").alias("entity_id"), F.col("embedding").alias("vector"), F.size("embedding").alias("dimension"), F.lit(EPOCH).alias("created_at")), "kg_vectors")

    def hyperedges(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(gid("part", "l_partkey"))).alias("parts"))
        orders = self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        members = F.concat(F.array(gid("customer", "o_custkey")), F.col("parts"))
        when = F.unix_timestamp("o_orderdate")
        return conform(
            orders.select(
                (F.col("o_orderkey").cast("long") + 1).alias("id"), F.lit("order").alias("hyperedge_type"), members.alias("entity_ids"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("weight"),
                F.size(members).alias("arity"), F.lit("{}").alias("properties"), when.alias("created_at"), when.alias("updated_at"),
            ), "kg_hyperedges",
        )

    def dependencies(self) -> DataFrame:
        """Parts depend on their suppliers, orders on their parts."""
        s = self._supplied_by().unionByName(self._contains())
        return conform(s.select("id", "source_id", "target_id", F.lit("depends_on").alias("dep_type"), "created_at"), "kg_dependencies")

    def confidence_log(self) -> DataFrame:
        e = self.table("events").where(F.col("event_type").isin("error", "purchase"))
        delta = F.when(F.col("event_type") == "error", -0.01).otherwise(0.01)
        return conform(
            e.select(F.col("event_id").cast("long").alias("id"), gid("user", "user_id").alias("entity_id"), F.lit(0.5).alias("old_value"), (F.lit(0.5) + delta).alias("new_value"), F.lit("feedback").alias("reason"), F.unix_timestamp("ts").alias("created_at")),
            "kg_confidence_log",
        )

    def versions(self) -> DataFrame:
        rows = [(1, "v1", "main", None, "even orders", EPOCH, False, 0), (2, "v2", "main", 1, "orders divisible by three", EPOCH + 1, False, 1)]
        return self.spark.createDataFrame(rows, "id long, name string, branch string, parent_id long, description string, created_at long, is_merged boolean, bit_slot int")

    def papers(self) -> DataFrame:
        """Parts in the shape of the papers import."""
        p = self.table("part")
        words = F.array_distinct(F.split(F.lower("p_name"), r"\s+"))
        return p.select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("arxiv_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("file_path"), F.to_json(words).alias("keywords"),
            F.round(F.col("p_retailprice") / 1000, 6).alias("utility"), F.col("p_brand").alias("skill_created"), F.lit(None).cast("string").alias("last_accessed"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("notes"),
        )

    def brands(self) -> DataFrame:
        """One skill for each brand; the description lists the types made under it."""
        p = self.table("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("types"))
        return p.select(F.col("p_brand").alias("name"), F.concat(F.lit("# "), "p_brand", F.lit("\n\nMakes "), "types", F.lit("\nmore")).alias("content"))
