"""Label selectors over labelled objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.session import broadcast_if, settled

# Objects that one salt of a token brings together, and the longest list of values that is
# tested within the row.
SALT_ROWS = 50_000
SHORT = 64


def selectors_from_rows(selectors: DataFrame, expressions: DataFrame) -> DataFrame:
    """(selector_id, exprs) out of one row per expression value.

    ``exprs`` is NULL for a selector that is itself NULL, empty for one without
    expressions.
    """
    one = F.struct("label_key", "operator", "vals")
    per_expr = (
        expressions.groupBy("selector_id", "expr_no", "label_key", "operator")
        .agg(F.collect_set("label_value").alias("vals"))
        .groupBy("selector_id")
        .agg(F.collect_list(one).alias("exprs"))
    )
    none = F.array().cast("array<struct<label_key:string,operator:string,vals:array<string>>>")
    return selectors.join(per_expr, "selector_id", "left").select(
        "selector_id", F.when(~F.col("is_null"), F.coalesce("exprs", none)).alias("exprs")
    )


def selector_expressions(selector: Column) -> Column:
    """``exprs`` of a spec document's selector: ``matchLabels`` are In with one value."""
    labels = F.transform(
        F.map_entries(selector["matchLabels"]),
        lambda e: F.struct(
            e["key"].alias("label_key"),
            F.lit("In").alias("operator"),
            F.array(e["value"]).alias("vals"),
        ),
    )
    exprs = F.transform(
        selector["matchExpressions"],
        lambda e: F.struct(
            e["key"].alias("label_key"),
            e["operator"].alias("operator"),
            F.coalesce(e["values"], F.array().cast("array<string>")).alias("vals"),
        ),
    )
    none = F.array().cast("array<struct<label_key:string,operator:string,vals:array<string>>>")
    return F.when(
        selector.isNotNull(), F.concat(F.coalesce(labels, none), F.coalesce(exprs, none))
    )


def satisfies(labels: Column, exprs: Column) -> Column:
    """Do ``labels`` (a map) satisfy all of ``exprs``?  ``NotIn`` and ``DoesNotExist``
    hold where the key is absent; an operator nobody knows holds nowhere."""

    def holds(e: Column) -> Column:
        value = labels[e["label_key"]]
        inside = F.coalesce(F.array_contains(e["vals"], value), F.lit(False))
        return (
            F.when(e["operator"] == "In", inside)
            .when(e["operator"] == "NotIn", ~inside)
            .when(e["operator"] == "Exists", value.isNotNull())
            .when(e["operator"] == "DoesNotExist", value.isNull())
            .otherwise(F.lit(False))
        )

    return F.coalesce(F.forall(exprs, holds), F.lit(False))


def _tokens(labels: Column) -> Column:
    """What an object shows: each label with its value, and each label alone."""
    return F.flatten(
        F.transform(
            F.map_entries(labels),
            lambda e: F.array(_token(e["key"], e["value"]), _token(e["key"])),
        )
    )


def _token(key: Column, value: Column | None = None) -> Column:
    # No two are written alike: the length says where the key ends, the mark that a value
    # follows, which may be empty.
    name = F.concat(F.char_length(key).cast("string"), F.lit(":"), key)
    return name if value is None else F.concat(name, F.lit("="), value)


def _shown_by(wanted: DataFrame) -> DataFrame:
    """(selector_id, expr_no, token): what an object shows that satisfies the expression.

    Only ``In`` and ``Exists`` are looked up; a selector without either is not here.
    """
    rows = wanted.select("selector_id", F.posexplode("exprs").alias("expr_no", "e")).select(
        "selector_id", "expr_no", "e.label_key", "e.operator", "e.vals"
    )
    key = F.col("label_key")
    tokens = F.when(
        F.col("operator") == "In",
        F.transform(F.array_distinct("vals"), lambda v: _token(key, v)),
    ).otherwise(F.array(_token(key)))
    return rows.filter(F.col("operator").isin("In", "Exists")).select(
        "selector_id", "expr_no", F.explode_outer(tokens).alias("token")
    )


def _lookups(shown_by: DataFrame, objects: DataFrame, small: bool) -> DataFrame:
    """(selector_id, expr_no, token, n) for the expression of a selector that fewest objects
    can satisfy: its tokens, and how many objects show each."""
    shown = objects.select(F.explode(_tokens(F.col("labels"))).alias("token"))
    asked = broadcast_if(shown_by.select("token").distinct(), small)
    shown = shown.join(asked, "token", "left_semi")
    counts = shown.groupBy("token").agg(F.count("*").alias("n"))
    costed = shown_by.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cost = costed.groupBy("selector_id", "expr_no").agg(F.sum("n").alias("cost"))
    rarest = cost.groupBy("selector_id").agg(F.min(F.struct("cost", "expr_no")).alias("first"))
    chosen = rarest.select("selector_id", F.col("first.expr_no").alias("expr_no"))
    return costed.filter("n > 0").join(chosen, ["selector_id", "expr_no"])


def select_by_labels(
    objects: DataFrame, selectors: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(selector_id, keys) for each object a selector selects.

    An inverted index instead of a product: a selector is looked up under the values of
    that expression, ``In`` or ``Exists``, that fewest objects satisfy, by the counts of all
    labels.  An object has one value per key, so it meets a selector at most once.  Only a
    selector that just excludes, and so selects nearly everything, meets all objects.

    Index rows are a selector and a token; a token many objects show is split into salts by
    its count; of few selectors, by rows and by bytes, the index is broadcast and no object is
    shuffled.  What a selector asks for besides is joined after the match: short lists are
    tested within the row, long ones by a join on their values, so no list of values is
    repeated for every object.
    """
    known = F.forall(
        "exprs", lambda e: F.coalesce(e["operator"].isin("In", "NotIn", "Exists", "DoesNotExist"), F.lit(False))
    )
    wanted = selectors.filter(F.col("exprs").isNotNull() & known)
    positive = F.exists("exprs", lambda e: e["operator"].isin("In", "Exists"))
    wanted, few = settled(wanted, "selectors")
    shown_by, small = settled(_shown_by(wanted.filter(positive)), "tokens")
    lookups = _lookups(shown_by, objects, small)
    dealt = F.xxhash64(*keys)
    shown = objects.select(*keys, "labels", F.explode(_tokens(F.col("labels"))).alias("token"))
    if small:
        met = shown.join(F.broadcast(lookups.select("selector_id", "token")), "token")
        met = met.select("selector_id", *keys, "labels")
    else:
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        index = lookups.select(
            "selector_id", "token", salts.alias("salts"),
            F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
        )
        split = index.select("token", "salts").distinct()
        probes = shown.join(split, "token").withColumn("salt", F.pmod(dealt, F.col("salts")).cast("int"))
        met = probes.join(index.drop("salts"), ["token", "salt"]).select("selector_id", *keys, "labels")

    # Selectors that only exclude: every object, by as many salts as there are partitions.
    excluding = wanted.filter(~positive).select("selector_id")
    if few:
        all_ = objects.crossJoin(F.broadcast(excluding)).select("selector_id", *keys, "labels")
    else:
        parts = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        everywhere = excluding.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        everyone = objects.select(*keys, "labels", F.pmod(dealt, F.lit(parts)).cast("int").alias("salt"))
        all_ = everyone.join(everywhere, "salt").select("selector_id", *keys, "labels")

    def short(e: Column) -> Column:
        return F.coalesce(F.size(e["vals"]), F.lit(0)) <= SHORT

    tested = wanted.select(
        "selector_id",
        F.filter("exprs", short).alias("exprs"),
        F.exists("exprs", lambda e: ~short(e)).alias("more"),
    )
    pairs = met.unionByName(all_).join(broadcast_if(tested, few), "selector_id")
    pairs = pairs.filter(satisfies(F.col("labels"), F.col("exprs")))
    done = pairs.filter("NOT more").select("selector_id", *keys)
    lists = wanted.select("selector_id", F.posexplode("exprs").alias("expr_no", "e")).filter(
        F.size("e.vals") > SHORT
    )
    lists = lists.select("selector_id", "expr_no", "e.label_key", "e.operator", F.array_distinct("e.vals").alias("vals"))
    values = lists.select("selector_id", "expr_no", F.explode("vals").alias("value"), F.lit(True).alias("inside"))
    asked = pairs.filter("more").select("selector_id", *keys, "labels").join(
        lists.drop("vals"), "selector_id"
    )
    asked = asked.withColumn("value", F.try_element_at("labels", "label_key")).join(
        values, ["selector_id", "expr_no", "value"], "left"
    )
    inside = F.coalesce("inside", F.lit(False))
    holds = F.when(F.col("operator") == "In", inside).when(F.col("operator") == "NotIn", ~inside)
    held = asked.groupBy("selector_id", *keys).agg(F.bool_and(F.coalesce(holds, F.lit(True))).alias("ok"))
    return done.unionByName(held.filter("ok").select("selector_id", *keys))
