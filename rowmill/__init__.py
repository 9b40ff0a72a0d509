"""rowmill: ready-made table operations on Spark DataFrames."""

from rowmill.operators import *  # noqa: F401,F403
from rowmill.operators import DATA_OPERATORS, OPERATORS, OUTPUT_OPERATORS
from rowmill.operators.lookup import find_filter_candidates, find_values
from rowmill.operators.profile import profile_table
from rowmill.operators.totals import sort_with_totals
from rowmill.plans.steps import StepError, apply_steps, check_steps, normalize_steps, preview_steps
from rowmill.sources.load import combine_files, combine_tables, infer_column_aliases, load_table
from rowmill.sources.regions import cells_from_csv, find_table_regions, read_region
from rowmill.sources.save import append_run_log, write_result
