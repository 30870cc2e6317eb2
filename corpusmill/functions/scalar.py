"""Column expressions: text fields, answers, hashes, schedules.  All stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_empty(c: ColumnLike) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(_col(c), F.lit(""))


def first_non_empty(*columns: ColumnLike) -> Column:
    """The first of some string columns that is neither null nor empty."""
    return F.coalesce(*(non_empty(c) for c in columns))


def first_non_empty_array(*columns: ColumnLike) -> Column:
    return F.coalesce(*(F.when(F.size(_col(c)) > 0, _col(c)) for c in columns))


def choice_letter_index(answer: ColumnLike) -> Column:
    """Number of the choice that a single letter (A, b, ...) names, or null."""
    a = F.trim(_col(answer))
    return F.when(a.rlike("^[A-Za-z]$"), F.ascii(F.upper(a)) - F.lit(ord("A")))


def resolve_answer(answer: ColumnLike, choices: ColumnLike) -> Column:
    """The text of an answer: a number or a single letter names one of the choices if there is one with
    that number; all else is the trimmed text itself.  Null stays null."""
    a, c = F.trim(_col(answer)), _col(choices)
    index = F.coalesce(F.when(a.rlike("^[0-9]{1,9}$"), a.cast("int")), choice_letter_index(answer))
    named = F.when(index.isNotNull() & (index < F.size(c)), F.get(c, index))
    return F.coalesce(F.trim(named), a)


def with_options(question: ColumnLike, choices: ColumnLike) -> Column:
    """The question, followed by a line with its choices where there are any."""
    q, c = _col(question), _col(choices)
    return F.when(F.size(c) > 0, F.concat(q, F.lit("\nOptions: "), F.array_join(c, "; "))).otherwise(q)


def glob_to_regex(pattern: ColumnLike) -> Column:
    """A shell pattern as an anchored regular expression; * and ? match / as well."""
    escaped = F.regexp_replace(_col(pattern), r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^(?s)"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def stable_seed(name: ColumnLike) -> Column:
    """The low 31 bits of a name's md5."""
    return F.conv(F.right(F.md5(_col(name)), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def uniform(*parts: ColumnLike) -> Column:
    """A number in [0, 1) from a text key, the same on every engine that has md5."""
    key = F.concat_ws("|", *(_col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def bigram_hash(current: ColumnLike, previous: ColumnLike, buckets: int) -> Column:
    """Bucket of a token and the one before it; the last bucket where there is none before.

    Computed in 64 bits, so no product overflows."""
    # The multipliers of the current and of the previous token.
    mixed = (F.lit(36313).cast("bigint") * _col(current).cast("bigint")).bitwiseXOR(F.lit(27191).cast("bigint") * _col(previous).cast("bigint"))
    return F.when(_col(previous).isNull(), F.lit(buckets - 1).cast("bigint")).otherwise(F.pmod(mixed, F.lit(buckets - 1).cast("bigint")))


def round_up(value: ColumnLike, step: int) -> Column:
    """The next multiple of ``step`` (in whole numbers)."""
    v = _col(value).cast("bigint")
    return v + F.pmod(-v, F.lit(step))


def shift_targets(tokens: ColumnLike) -> tuple[Column, Column]:
    """Inputs and next-token targets of a token array."""
    t = _col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n)


def chunked(tokens: ColumnLike, length: int) -> Column:
    """An array of runs of ``length`` tokens; the last may be shorter."""
    t = _col(tokens)
    starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(t, i + 1, F.lit(length)))


def padded_to(tokens: ColumnLike, multiple: int, filler: int = 0) -> Column:
    """The array, filled up to a multiple of ``multiple``."""
    t = _col(tokens)
    return F.concat(t, F.array_repeat(F.lit(filler).cast("int"), F.pmod(-F.size(t), F.lit(multiple)).cast("int")))


def finite(c: ColumnLike) -> Column:
    return _col(c).isNotNull() & ~F.isnan(_col(c)) & (F.abs(_col(c)) < F.lit(float("inf")))


def perplexity(nats: ColumnLike, cap: float = 20.0) -> Column:
    return F.exp(F.least(_col(nats), F.lit(cap)))


def stage_value(step: ColumnLike, stages: Sequence[tuple[int, float]]) -> Column:
    """Value of the stage a step falls in; ``stages`` are (end, value), ends ascending and exclusive, and
    the last value holds from then on."""
    out = None
    for end, value in stages[:-1]:
        hit = _col(step) < end
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    last = F.lit(stages[-1][1])
    return last if out is None else out.otherwise(last)


def warmup_cooldown(step: ColumnLike, total: int, warmup: int, cooldown: int, floor: float = 0.0) -> Column:
    """A rate that rises to 1 over ``warmup`` steps and falls to ``floor`` over the last ``cooldown``."""
    s = _col(step).cast("double")
    falling = F.lit(floor) + (1 - floor) * F.greatest(F.lit(total) - s, F.lit(0.0)) / float(max(cooldown, 1))
    return F.when(s < warmup, (s + 1) / float(max(warmup, 1))).when(s >= total - cooldown, falling).otherwise(F.lit(1.0))


def cosine_decay(step: ColumnLike, total: int, floor: float = 0.0) -> Column:
    s = F.least(_col(step).cast("double") / float(total), F.lit(1.0))
    return F.lit(floor) + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * s))


def linear_ramp(step: ColumnLike, total: int, begin: float, end: float) -> Column:
    return F.lit(begin) + (end - begin) * F.least(_col(step).cast("double") / float(max(total, 1)), F.lit(1.0))


def loss_weight(message_weight: ColumnLike, n_tokens: ColumnLike, n_sub: ColumnLike) -> Column:
    """Weight of each of an answer's tokens: damped by the answer's length and by the conversations that share an image."""
    return _col(message_weight) / F.sqrt(F.greatest(_col(n_tokens), F.lit(1))) / F.sqrt(F.greatest(_col(n_sub), F.lit(1)))


def evidence(link: ColumnLike) -> Column:
    """The readable part of a Markdown link, without back ticks."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(link), r"\[([^\]]*)\]\([^)]*\)", "$1"), "`", ""))


def throughput(tokens: ColumnLike, seconds: ColumnLike) -> Column:
    return F.when(_col(seconds) > 0, _col(tokens) / _col(seconds))


def utilisation(tokens_per_s: ColumnLike, flops_per_token: float, peak_flops: float) -> Column:
    return _col(tokens_per_s) * F.lit(flops_per_token) / F.lit(peak_flops)
