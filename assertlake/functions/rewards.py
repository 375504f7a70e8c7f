"""Rewards and verdicts as expressions over joined columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values.
EQUIVALENCE = {"EQUIVALENT": 1.0, "IMPLIES_REF_TO_LM": 0.6, "IMPLIES_LM_TO_REF": 0.4, "NOT_EQUIVALENT": 0.0}
TIERED = {"EQUIVALENT": 1.0, "IMPLIES_REF_TO_LM": 0.5, "IMPLIES_LM_TO_REF": 0.5, "NOT_EQUIVALENT": 0.2}
FORMAL = {"PASS": 1.0, "VACUOUS": 0.2, "FAIL": 0.5, "TIMEOUT": 0.3, "PARSE_ERROR": 0.0, "EXTRACT_ERROR": 0.0}
COMBINED = {"PASS": 1.0, "FAIL": 0.5, "TIMEOUT": 0.3, "VACUOUS": 0.0, "PARSE_ERROR": 0.0, "EXTRACT_ERROR": 0.0, "UNSUPPORTED": 0.5}
PUBLIC = ("EQUIVALENT", "IMPLIES_REF_TO_LM", "IMPLIES_LM_TO_REF", "NOT_EQUIVALENT", "UNSUPPORTED")
UNDECIDED = ("UNSUPPORTED", "TIMEOUT", "PARSE_ERROR", "UNKNOWN", "EXTRACT_ERROR")
VERDICT_RANK = {"EQUIVALENT": 4, "IMPLIES_REF_TO_LM": 3, "IMPLIES_LM_TO_REF": 2, "NOT_EQUIVALENT": 1, "UNSUPPORTED": 0}


def looked_up(values: dict[str, float], key: Column, default: Column | None = None) -> Column:
    out = F.lit(None).cast("double") if default is None else default
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def verdict(forward: Column, backward: Column) -> Column:
    """struct(verdict, internal_status) of the two directions' statuses."""
    either = lambda s: (forward == s) | (backward == s)
    public = (
        F.when((forward == "PASS") & (backward == "PASS"), "EQUIVALENT")
        .when((forward == "PASS") & (backward == "FAIL"), "IMPLIES_REF_TO_LM")
        .when((forward == "FAIL") & (backward == "PASS"), "IMPLIES_LM_TO_REF")
        .when((forward == "FAIL") & (backward == "FAIL"), "NOT_EQUIVALENT")
        .otherwise("UNSUPPORTED")
    )
    inner = F.when(public != "UNSUPPORTED", "").when(either("PARSE_ERROR"), "PARSE_ERROR").when(either("TIMEOUT"), "TIMEOUT").otherwise("UNKNOWN")
    return F.struct(public.alias("verdict"), inner.alias("internal_status"))


def public_verdict(v: Column) -> Column:
    return F.when(v.isin(*PUBLIC), v).otherwise("UNSUPPORTED")


def equivalence(v: Column, syntax_ok: Column, has_text: Column, failed: Column | None = None) -> Column:
    """The graded reward; failed: the check raised."""
    graded = F.when(v == "UNSUPPORTED", 0.15).otherwise(looked_up(EQUIVALENCE, v, F.lit(0.0)))
    graded = graded if failed is None else F.when(failed, 0.05).otherwise(graded)
    return F.when(has_text & syntax_ok, graded).otherwise(0.0)


def edit(syntax_ok: Column, similarity: Column) -> Column:
    return 0.4 * syntax_ok.cast("double") + 0.6 * similarity


def hybrid(syntax_ok: Column, similarity: Column, equivalence_: Column) -> Column:
    return 0.20 * syntax_ok.cast("double") + 0.30 * similarity + 0.50 * equivalence_


def best_reference(verdicts: Column, syntax_ok: Column, has_text: Column) -> Column:
    """The greatest graded reward over an array of verdicts; 0 without any."""
    return F.coalesce(F.array_max(F.transform(verdicts, lambda v: equivalence(v, syntax_ok, has_text))), F.lit(0.0))


def tiered(v: Column, syntax_ok: Column, has_text: Column, compiles: Column, agreement_: Column) -> Column:
    undecided = F.lit(0.15) + F.coalesce(0.50 * agreement_, F.lit(0.0))
    return F.when(~(has_text & syntax_ok), 0.0).when(~compiles, 0.05).when(v.isin(*UNDECIDED), undecided).otherwise(looked_up(TIERED, v, F.lit(0.10)))


def dynamic(syntax_ok: Column, has_text: Column, compiles: Column, agreement_: Column) -> Column:
    return F.when(~(has_text & syntax_ok), 0.0).when(~compiles, 0.05).otherwise(F.coalesce(agreement_, F.lit(0.10)))


def agreement(cycles: Column, fail_ref: Column, fail_gen: Column) -> Column:
    """How far two simulations agree; null for no cycles."""
    return F.when(cycles > 0, F.when(F.greatest(fail_ref, fail_gen) == 0, 1.0).otherwise(1.0 - F.abs(fail_ref - fail_gen) / F.greatest(fail_ref, fail_gen)))


def formal(status: Column) -> Column:
    """UNKNOWN counts as FAIL; null for UNSUPPORTED."""
    return looked_up(FORMAL, F.when(status == "UNKNOWN", "FAIL").otherwise(status))


def combined(syntax_ok: Column, status: Column, vacuous: Column, similarity: Column) -> Column:
    return 0.15 * syntax_ok.cast("double") + 0.40 * looked_up(COMBINED, status, F.lit(0.0)) + 0.20 * (~vacuous).cast("double") + 0.25 * similarity


def rollout_weight(v: Column, strict: bool) -> Column:
    return F.when(v == "EQUIVALENT", 1.0).otherwise(0.0) if strict else looked_up({k: x for k, x in EQUIVALENCE.items() if x}, v, F.lit(0.0))


def syntax_only(syntax_ok: Column) -> Column:
    return 0.15 * syntax_ok.cast("double")


def token_cost(tokens: Column, per_million: float = 0.60) -> Column:
    return tokens / 1e6 * per_million


#: Error lines of a proof run come first, they mask the rest; fixed values.
PARSE_ERRORS = r"(?i)ERROR: Compilation failed|ERROR: (?:syntax|elaborat|compile|SLANG|No such command)|error: unknown system name|error: use of undeclared identifier|error: could not find module|Build failed"


def log_status(log: Column) -> Column:
    return (
        F.when(log.rlike(PARSE_ERRORS), "PARSE_ERROR")
        .when(log.contains("engine_0 (smtbmc z3) returned PASS") | log.rlike(r"(?i)summary:\s+engine_0[^\n]*pass\b"), "PASS")
        .when(log.rlike(r"engine_0 \(smtbmc z3\) returned FAIL|returned FAIL for basecase"), "FAIL")
        .when(F.lower(log).contains("unreachable") & F.lower(log).contains("cover"), "VACUOUS")
        .otherwise("UNKNOWN")
    )
