from metricwatch.sources.catalog import Sources, StandInSources  # noqa: F401
from metricwatch.sources.lineage import cut_lineage, discard, new_folder, written  # noqa: F401
