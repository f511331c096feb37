"""Splits that keep related records together (problem 2): grouped iterative stratification.

Records that share a value are linked to the smallest record with it, components are found on these
links, and each component becomes a vector of label counts. Components are then placed, rarest
outstanding label first, into the split that needs the label most. The few components that hold a
notable share of all records are placed first, one by one; the many small ones are placed in
independent buckets, each of which gets its share of every need, so no task or driver sees them all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.llm.components import components
from lodestrata.llm.deliveries import latest_delivery
from lodestrata.llm.names import firm, folder, person, plain, split_name
from lodestrata.session import cut

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: A component of more than this share of all records is placed on the driver: there are at most
#: its reciprocal of them.
LARGE_SHARE = 1 / 2_000
#: Records that one bucket of small components holds, about.
BUCKET_RECORDS = 40_000
#: Most different labels; labels come from columns of few values.
MOST_LABELS = 2_000

_COLUMNS = ["document_id", "document_group_id", "source_file", "author", "entity", "split", "dataset", "category", "answerable", "context_mode"]


def relations() -> dict[str, Column]:
    """What relates two records of rag_export when it is equal."""
    return {
        "document": plain(F.col("document_id")),
        "group": plain(F.col("document_group_id")),
        "report": folder(F.col("source_file")),
        "author": person(F.col("author")),
        "entity": firm(F.col("entity")),
    }


def related_groups(records: DataFrame, key: str = "record_no", by: dict[str, Column] | None = None) -> DataFrame:
    """(key, group_no) of every distinct key; group_no is the smallest key it is related to.

    Rows relate if any value of by is equal and not null, directly or through others. Rows without
    key are left out, as nothing names them.
    """
    named = by or relations()
    values = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in named.items()])
    held = records.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), F.explode(values).alias("v")).select("node", "v.kind", "v.value").where(F.col("value").isNotNull()).distinct()
    held = cut(held)
    least = held.groupBy("kind", "value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = held.withColumnRenamed("node", "a").join(least, ["kind", "value"]).select("a", "b")
    nodes = records.select(F.col(key).alias("node"))
    return components(nodes, edges).select(F.col("node").alias(key), F.col("component").alias("group_no"))


def groups_across_splits(records: DataFrame) -> DataFrame:
    """(record_no, group_no) of every record of a group whose split values name more than one split.

    Deliveries of one record_no count once, by the latest. Null and unknown split names are none.
    """
    rows = latest_delivery(records, "record_no", _COLUMNS)
    rows = cut(rows.select("record_no", *[v.alias(k) for k, v in relations().items()], split_name(F.col("split")).alias("split")))
    groups = cut(related_groups(rows, by={k: F.col(k) for k in relations()}))
    said = groups.join(rows.select("record_no", "split").where(F.col("split").isNotNull()), "record_no")
    torn = said.groupBy("group_no").agg(F.min("split").alias("first"), F.max("split").alias("last")).where(F.col("first") != F.col("last")).select("group_no")
    return groups.join(torn, "group_no", "left_semi").select("record_no", "group_no")


def stratify(groups: Iterable[tuple[int, dict[str, int]]], need: dict[str, dict[str, float]]) -> dict[int, str]:
    """Split of each group; need is changed to what is left of it.

    groups: (id, records by label), the label "" counting all records. The label with the fewest
    outstanding records comes next; its groups, largest first, go where need of that label is
    largest, then need of records, then by name.
    """
    vectors = dict(groups)
    waiting: dict[str, list[int]] = defaultdict(list)
    left: dict[str, int] = defaultdict(int)
    for g, vector in vectors.items():
        for label, n in vector.items():
            waiting[label].append(g)
            left[label] += n
    for label, ids in waiting.items():
        ids.sort(key=lambda g: (-vectors[g][label], -vectors[g].get("", 0), g))
    placed: dict[int, str] = {}
    while True:
        open_labels = [(n, label) for label, n in left.items() if n > 0 and label] or [(n, label) for label, n in left.items() if n > 0]
        if not open_labels:
            return placed
        label = min(open_labels)[1]
        for g in waiting[label]:
            if g in placed:
                continue
            split = max(need, key=lambda s: (need[s].get(label, 0.0), need[s].get("", 0.0), s))
            # a split that is full as a whole takes no more while another has room
            if need[split].get("", 0.0) < 0.5 * vectors[g].get("", 0):
                split = max(need, key=lambda s: (need[s].get("", 0.0), need[s].get(label, 0.0), s))
            placed[g] = split
            for other, n in vectors[g].items():
                need[split][other] = need[split].get(other, 0.0) - n
                left[other] -= n
        left[label] = 0


def assign_splits(records: DataFrame, shares: dict[str, float] = SHARES, labels: tuple[str, ...] = ("dataset", "category", "answerable", "context_mode")) -> DataFrame:
    """(record_no, group_no, assigned_split): related records share a split, shares hold per label.

    Deliveries of one record_no count once. A null label value is a label of its own. An empty
    table gives an empty result.
    """
    rows = latest_delivery(records, "record_no", _COLUMNS)
    tags = F.array(F.lit(""), *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("?"))) for c in labels])
    rows = cut(rows.select("record_no", *[v.alias(k) for k, v in relations().items()], tags.alias("tags")))
    groups = cut(related_groups(rows, by={k: F.col(k) for k in relations()}))
    counts = cut(groups.join(rows.select("record_no", "tags"), "record_no").select("group_no", F.explode("tags").alias("label")).groupBy("group_no", "label").agg(F.count(F.lit(1)).alias("n")))

    totals = {r.label: r.n for r in counts.groupBy("label").agg(F.sum("n").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(totals) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels; stratify by columns of few values")
    n_all = totals.get("", 0)
    need = {s: {label: share * n for label, n in totals.items()} for s, share in shares.items()}

    # at most 1 / LARGE_SHARE groups are large, whatever the data
    sizes = counts.where(F.col("label") == "").select("group_no", F.col("n").alias("size"))
    large = sizes.where(F.col("size") > max(1.0, n_all * LARGE_SHARE)).select("group_no")
    vectors: dict[int, dict[str, int]] = {}
    for r in counts.join(large, "group_no", "left_semi").groupBy("group_no").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector")).collect():
        vectors[r.group_no] = r.vector
    placed = stratify(sorted(vectors.items()), need)

    spark = records.sparkSession
    fixed = spark.createDataFrame(list(placed.items()) or [(-1, "train")], "group_no long, assigned_split string").where(F.lit(bool(placed)))
    buckets = max(1, -(-n_all // BUCKET_RECORDS))
    rest = counts.join(fixed.select("group_no"), "group_no", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("group_no"), F.lit(buckets)))
    weight = {label: totals[label] - sum(v.get(label, 0) for v in vectors.values()) for label in totals}

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, dict[str, int]] = defaultdict(dict)
        for g, label, n in zip(pdf["group_no"], pdf["label"], pdf["n"]):
            own[int(g)][label] = int(n)
        here = pdf.groupby("label")["n"].sum()
        mine = {s: {label: need[s][label] * int(n) / weight[label] for label, n in here.items() if weight[label]} for s in need}
        done = stratify(sorted(own.items()), mine)
        return pd.DataFrame({"group_no": list(done), "assigned_split": list(done.values())})

    small = rest.groupBy("bucket").applyInPandas(place, "group_no long, assigned_split string")
    return groups.join(small.unionByName(fixed), "group_no").select("record_no", "group_no", "assigned_split")
