"""Record scoring as one job: model records and references to judged fields and their tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from docstruct.operators.fields import (
    RECORD, field_metrics, field_outcomes, judge, leaves, n_reference_fields, score_table, split_invalid,
)
from docstruct.sources.io import export_scores


def score_records(
    records: DataFrame, references: DataFrame, raw: str = "raw", keys: Sequence[str] = RECORD, on: Sequence[str] = ("doc_id",),
    by: Sequence[str] = ("run", "model"), out: str | None = None,
) -> dict[str, DataFrame]:
    """Score *records* ``(keys, raw)`` against *references* ``(on, raw)``, one per document.

    ``every_field``: a row per field written or missed (J12). ``per_record``: counts and scores of each
    record (J14). ``outcomes``: Correct, Mismatch or Missed per annotated field (J15). ``summary``: scores
    per document and pooled, by *by* (J18). ``invalid``: records without a JSON object, with the reason (J31).
    Records whose document has no reference are in none of the tables.

    With *out* the judged fields are written to ``<out>/every_field`` first and the other tables are made
    from what was written, so records are walked once; without it each table walks them for itself.
    """
    valid, invalid = split_invalid(records, raw)
    judged = judge(valid, references, raw, keys, on)
    if out is not None:
        export_scores(out, every_field=judged)
        judged = judged.sparkSession.read.schema(judged.schema).parquet(f"{out}/every_field")
    n_ref = n_reference_fields(leaves(references, raw, on), on)
    tables = {
        "per_record": field_metrics(judged, n_ref, keys, on), "outcomes": field_outcomes(judged, keys),
        "summary": score_table(judged, by), "invalid": invalid,
    }
    if out is not None:
        export_scores(out, **tables)
    return {"every_field": judged} | tables
