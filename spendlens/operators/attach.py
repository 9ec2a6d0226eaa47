"""Attach labels to every activity: unique labels per text, then a many-to-one left join.

The join key is the text's SHA-256, so neither side ships the text through the
shuffle. Labels are unique per key, the activity side keeps its row count.
AQE broadcasts the label side when its measured size is under the threshold.
Otherwise the join is shuffled on a place: the key, or for a hot key the key and a salt.
The empty text, which has no label, gets places that no label row has, so its rows spread
over all tasks and pass through the same join; texts on more rows than one task should get
are salted over several places, since AQE's own skew split does not apply when the label
side arrives already partitioned by its deduplication. The activities are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import ColumnOrName, qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.functions.text import text_key
from spendlens.operators.prepare import keep_first, with_text_key


def labels_unique(labels: DataFrame, fields: Fields = DEFAULT, order: ColumnOrName | Sequence[ColumnOrName] | None = None) -> DataFrame:
    """First label per text key (by ``order``, default the label ordinal); a table
    without a text key is passed through unchanged."""
    lab = labels
    if fields.key not in lab.columns:
        if fields.text not in lab.columns:
            return lab
        lab = lab.withColumn(fields.key, text_key(qcol(fields.text)))
    if order is None:
        if fields.ordinal in lab.columns:
            order = fields.ordinal
        else:  # no order to be first in: the choice must still be the same every time
            order = [c for c in lab.columns if c != fields.key]
    return keep_first(lab, fields.key, order)


PLACE = "__place"
# Key of the empty text: every activity without a usable description carries it,
# which makes it the most likely hot key; it never has a label row.
BLANK_KEY = hashlib.sha256(b"").hexdigest()
# Places that the rows of the empty text are dealt over.
BLANK_PLACES = 1 << 20


def attach_labels(
    activities: DataFrame,
    labels: DataFrame,
    fields: Fields = DEFAULT,
    label_columns: Sequence[str] | None = None,
    dedupe: bool = True,
    hot_keys: DataFrame | None = None,
) -> DataFrame:
    """Left join labels on the text key: every activity row kept, label columns NULL
    where unlabelled. Label columns that clash with activity columns get the
    ``fields.clash_suffix``; the label table's own text column is not carried.

    Activities with the empty text have no label, and are dealt over places of their own.
    ``hot_keys`` (key, buckets; see ``prepare.hot_keys``) are salted: their activity
    rows are dealt over that many places by a hash of the row, and their label rows are
    repeated once for each, so no task receives all rows of one text. Without hot keys
    a label's place is its key. Results are the same.
    """
    acts = with_text_key(activities, fields)
    lab = labels_unique(labels, fields) if dedupe else labels
    if fields.key not in lab.columns:
        raise ValueError("labels need a text or text key column")
    keep = [c for c in (label_columns or lab.columns) if c not in (fields.key, fields.text)]
    names = {c: c + fields.clash_suffix if c in acts.columns else c for c in keep}
    key = qcol(fields.key)
    right = lab.select(key, *[qcol(c).alias(names[c]) for c in keep])
    row = F.xxhash64(*([qcol(fields.ordinal)] if fields.ordinal in acts.columns else [qcol(c) for c in activities.columns]))
    place = F.when(key == BLANK_KEY, F.concat(F.lit("blank-"), F.pmod(row, F.lit(BLANK_PLACES)).cast("string")))
    if hot_keys is None:
        left = acts.withColumn(PLACE, place.otherwise(key))
        right = right.withColumnRenamed(fields.key, PLACE)
    else:
        hot = F.broadcast(hot_keys.select(key, F.col("buckets").alias("__buckets")))  # a bounded list
        left = acts.join(hot, on=fields.key, how="left")
        salt = F.pmod(row, F.col("__buckets")).cast("string")
        left = left.withColumn(PLACE, place.when(F.col("__buckets").isNotNull(), F.concat_ws("-", key, salt)).otherwise(key)).drop("__buckets")
        places = F.when(F.col("__buckets").isNull(), F.array(key)).otherwise(F.transform(F.sequence(F.lit(0), F.col("__buckets") - 1), lambda s: F.concat_ws("-", key, s.cast("string"))))
        right = right.join(hot, on=fields.key, how="left").withColumn(PLACE, F.explode(places)).drop("__buckets", fields.key)
    joined = left.join(right, on=PLACE, how="left")
    return joined.select(*[qcol(c) for c in (*acts.columns, *names.values())])
