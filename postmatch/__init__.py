"""Match text postings against profiles on Spark."""

from postmatch.operators.score import score_postings
from postmatch.options import MatchOptions
from postmatch.plans.batch import run_match
from postmatch.streaming.incremental import score_new_files

__all__ = ["MatchOptions", "run_match", "score_new_files", "score_postings"]
