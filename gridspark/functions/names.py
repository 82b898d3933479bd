"""Run names, comments, paths, timestamps and job states as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.functions.scalars import _col

# The letter codes used in run names and the divisor that turns
# their digits into physical units.  Widths of N differ by naming family.
NAME_TOKENS = {
    "U": ("U(-?[0-9]+)", 100.0),
    "N": ("N([0-9]+)", None),
    "Amp": ("Amp([0-9]+)", 1.0),
    "K": ("K([0-9]+)", 1.0),
    "f": ("f([0-9]+)", 1e6),
    "B": ("B([0-9]+)", 1.0),
    "alpha": ("alpha([0-9]+)", 100.0),
    "u": ("u([0-9]+)", 100.0),
}
# Names carrying "alpha" count N in 1e-5 1/s; the others in 1e-4 1/s.
N_DIVISOR_SLOPE = 1e5
N_DIVISOR_HILL = 1e4

# Free-text parameters found in run comments.
COMMENT_TOKENS = {
    "alpha": r"alpha ?= ?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)",
    "dhdx": r"dhdx ?= ?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)",
    "u_0": r"u_0 ?= ?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)",
    "N_0": r"N_0 ?= ?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)",
}

RUN_IN_PATH = "results/([^/]+)/"
STAMP_SPARK = "yyyy-MM-dd HH:mm:ss"
STAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\s*$"


def run_label(prefix: str, number, width: int = 3) -> Column:
    """``prefix`` followed by a zero-padded number."""
    return F.format_string(f"{prefix}%0{width}d", _col(number))


def _captured(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def name_parameters(run="run") -> list[Column]:
    """Parameters coded in a run name; NULL where the token is absent.

    Letters also occur inside words, so each token must be a code letter directly
    followed by digits.
    """
    name = _col(run)
    out = []
    for token, (pattern, divisor) in NAME_TOKENS.items():
        digits = _captured(name, pattern)
        # Column names ignore case, so the lower-case flow token gets its own name.
        out.append(digits.alias("flow_raw" if token == "u" else f"{token}_raw"))
        if divisor is not None:
            label = {"u": "flow", "U": "U0", "f": "f0", "Amp": "height"}.get(token, token)
            out.append((digits.cast("double") / divisor).alias(label))
    has_slope = name.rlike("alpha[0-9]+")
    n_raw = _captured(name, NAME_TOKENS["N"][0]).cast("double")
    out.append(F.when(has_slope, n_raw / N_DIVISOR_SLOPE).otherwise(n_raw / N_DIVISOR_HILL).alias("N0"))
    return out


def comment_parameters(comment="comment") -> list[Column]:
    """Parameters written as ``name = value`` in free text."""
    text = _col(comment)
    out = []
    for token, pattern in COMMENT_TOKENS.items():
        number = F.regexp_replace(_captured(text, pattern), r"\.$", "")
        out.append(number.try_cast("double").alias(token))
    out.append(
        F.when(text.rlike("const\\w* strat|conststrat"), "const")
        .when(text.rlike("exp strat|exponential strat"), "exp")
        .alias("strat")
    )
    return out


def run_of_path(path, pattern: str = RUN_IN_PATH) -> Column:
    """Run name inside a path, by default ``…/results/<run>/…``."""
    return _captured(_col(path), pattern)


def parse_stamp(text) -> Column:
    return F.try_to_timestamp(F.trim(_col(text)), F.lit(STAMP_SPARK))


def format_stamp(ts) -> Column:
    return F.date_format(_col(ts), STAMP_SPARK)


def job_label(job_id, state, reason, exit_code, first_pending) -> Column:
    """One job's status text: the first pending job shows its reason, done jobs their exit code."""
    job_id, state, reason, exit_code = map(_col, (job_id, state, reason, exit_code))
    return (
        F.when((state == "PENDING") & _col(first_pending), F.format_string("%s: %s %s", job_id, state, reason))
        .when(state == "PENDING", job_id)
        .when(state == "COMPLETED", F.format_string("%s: done: %s", job_id, exit_code))
        .otherwise(F.format_string("%s: %s", job_id, F.coalesce(state, F.lit("unknown"))))
    )
