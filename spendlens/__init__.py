"""spendlens: thematic spend labelling and reporting on Spark.

Stages, all DataFrame in / DataFrame out:

* ``sources``   – yearly activity files, CSV/Parquet scans, dimensions, sinks
* ``functions`` – Column expressions (activity text, strip, tokens, response parsing)
* ``operators`` – text preparation, labelling job, label attachment, marker logic, reports
* ``streaming`` – incremental (resumable) labelling as a Structured Streaming query
* ``plans``     – staged runs (land → report) and the query catalogue used for checks
"""

from spendlens.fields import Fields
from spendlens.taxonomy import CONTINUUM, SUBSECTORS, Taxonomy

__all__ = ["Fields", "Taxonomy", "CONTINUUM", "SUBSECTORS"]
