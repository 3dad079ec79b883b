"""Frequency of every distinct value or term, with marks for the useless ends."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RARE_BELOW = 5
COMMON_ABOVE = 0.2


def canonical(value: str | None) -> str | None:
    """White space off both ends, lower case, NFC; null for null and blank."""
    if value is None:
        return None
    return unicodedata.normalize("NFC", value.strip().lower()) or None


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])))
def _counted(lists: pa.Array) -> pa.Array:
    """(term, n) for each distinct term of each record; each distinct spelling of a batch is handled once."""
    coded = lists.flatten().dictionary_encode()
    # codes of the canonical forms; spellings of one form share a code, null and blank have none
    forms = pa.array([canonical(v) for v in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code_of = np.append(forms.indices.fill_null(-1).to_numpy(zero_copy_only=False), -1).astype(np.int64)
    codes = code_of[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
    record = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    kinds = max(1, len(forms.dictionary))
    pairs, times = np.unique((record * kinds + codes)[codes >= 0], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(lists) + 1) * kinds).astype(np.int32)
    terms = pa.StructArray.from_arrays([forms.dictionary.take(pa.array(pairs % kinds)), pa.array(times, pa.int64())], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), terms)


def _named(field: str, counts: Column) -> Column:
    return F.transform(counts, lambda x: F.struct(F.lit(field).alias("field_name"), x["term"].alias("term"), x["n"].alias("n")))


def term_stats(
    records: DataFrame,
    scalar_fields: Sequence[str] = (),
    array_fields: Sequence[str] = (),
    rare_below: int = RARE_BELOW,
    common_above: float = COMMON_ABOVE,
) -> DataFrame:
    """(field_name, term, occurrences, records, mark) of every term of every field.

    Each record emits the counts of its own terms; those are combined by a hash of (field, term)
    before the shuffle and summed after it, so a term that stands in every record crosses the
    network once a task. ``mark`` is 'rare' below ``rare_below`` records, 'common' above
    ``common_above`` of all records, else null; a term that is both (tiny inputs) is 'rare'.

    Null, blank and empty arrays are no term; an element repeated in a record counts each time as
    an occurrence and once as a record. All records count in the share, also those without terms.
    """
    lists = [F.array(F.col(f).cast("string")) for f in scalar_fields]
    lists += [F.coalesce(F.col(f), F.array().cast("array<string>")) for f in array_fields]
    names = [*scalar_fields, *array_fields]
    cleaned = records.select(*[_counted(c).alias(f"_f{i}") for i, c in enumerate(lists)])
    per_record = F.concat(*[_named(n, F.col(f"_f{i}")) for i, n in enumerate(names)])
    summed = cleaned.select(F.explode(per_record).alias("e")).groupBy("e.field_name", "e.term").agg(F.sum("e.n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    total = records.agg(F.count(F.lit(1)).alias("_total"))
    marked = summed.crossJoin(F.broadcast(total))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.col("_total"), "common")
    return marked.select("field_name", "term", "occurrences", "records", mark.alias("mark"))
