"""Problem 5: records that differ only by white space, letter case, punctuation or the order of opening fields."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.common import folded
from affinis.llm.components import connected_components
from affinis.runtime import spread, stage

_NOT_ALNUM = re.compile(r"[\W_]+")
_FIELD = re.compile(r"\s*[^\W\d_]+\s*:\s*\S.*")
_LATIN = re.compile(r"\s*[a-zªºß-öø-ɏḀ-ỿ]+\s*:")
_BREAKS = re.compile(r"\r\n|\r|\n")


def canonical_forms(text: str | None) -> tuple[str, str] | None:
    """(letters and digits in order, the same with opening fields as a sorted collection), or None without any.

    The second form marks its fields and equals the first where the text does not open with fields.
    """
    if text is None:
        return None
    low = folded(text)
    plain = _NOT_ALNUM.sub("", low)
    if not plain:
        return None
    lines = _BREAKS.split(low)
    blank = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
    head = lines[:blank]
    if not head or not all(_FIELD.fullmatch(x) and _LATIN.match(x) for x in head):
        return plain, plain
    fields = sorted("\x01".join(_NOT_ALNUM.sub("", part) for part in x.split(":", 1)) for x in head)
    body = _NOT_ALNUM.sub("", "\n".join(lines[blank:]))
    return plain, "\x02".join(fields) + "\x03" + body


@F.pandas_udf(T.StructType([T.StructField("plain", T.StringType()), T.StructField("canon", T.StringType())]))
def _forms(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([canonical_forms(t) or (None, None) for t in texts], columns=["plain", "canon"])


def _key(form: Column) -> Column:
    """128-bit key, 64 further bits and the length of a form in one text: forms are equal only where all three are."""
    digest = F.sha2(form, 256)
    return F.concat_ws(":", F.substring(digest, 1, 32), F.substring(digest, 33, 16), F.octet_length(form).cast("string"))


def canonical_keys(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each record that has letters or digits: ident, plain and key, the keys of its two forms.

    ASCII texts whose first line has no colon, so no fields, are made canonical inside the engine.
    """
    t = F.col("_t")
    simple = ~t.rlike(r"[^\x00-\x7F]") & ~t.rlike(r"^[^\r\n]*:")
    told = spread(items.select(F.col(ident), F.col(text).alias("_t"))).where(t.isNotNull())
    told = told.select(ident, F.when(simple, F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")).alias("_p"), _forms(F.when(~simple, t)).alias("_f"))
    formed = told.select(ident, F.coalesce("_p", "_f.plain").alias("_p"), F.coalesce("_p", "_f.canon").alias("_c")).where("_p <> ''")
    return formed.select(ident, _key(F.col("_p")).alias("plain"), _key(F.col("_c")).alias("key"))


def copy_groups(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """kept_<ident>, <ident>, copies for every record with letters or digits; records alone in their group have copies 1.

    Copies are counted with map-side combining on the 128-bit key. A text without fields may spell out a text with
    fields letter by letter; such bridges between two keys are united by connected components. Null and blank texts
    are left out; repeated rows with their own ident are copies; a repeated ident counts once per row.
    """
    keyed = stage(canonical_keys(items, ident, text), "canon")
    spelled = keyed.groupBy("plain").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    if not spelled.isEmpty():
        bridges = keyed.join(spelled, "plain").select(F.col("key").alias("src"), F.col("lo").alias("dst")).distinct()
        united = connected_components(bridges.where("src <> dst"), "src", "dst")
        keyed = keyed.join(united.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("key", F.coalesce("component", "key"))
    groups = keyed.groupBy("key").agg(F.min(ident).alias(f"kept_{ident}"), F.count(F.lit(1)).alias("copies"))
    return keyed.select("key", ident).join(groups, "key").select(f"kept_{ident}", ident, "copies")
