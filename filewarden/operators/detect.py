"""The detectors: one narrow pass over content, no shuffle.

Every detector turns a `files(path, content, ...)` table into rows about it.
:func:`analyse` combines all layers in the row itself: content is read once, the
rules that have a chance to match are evaluated, and what leaves the projection
is a short ranked array of threats per file. Content never meets an exchange.

Three things keep the pass cheap on large corpora:

* a rule's regex runs only where its needles (plain substrings) occur;
* match, position, surroundings and threat struct are separate projections, so
  each is computed once, and only for files that matched;
* a rule whose confidence can never reach the threshold emits no expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewarden.functions import bytestring as bs
from filewarden.functions.entropy import byte_counts, byte_entropy, entropy_of_counts
from filewarden.functions.severity import entropy_band, number_text, obfuscation_band, severity_rank
from filewarden.functions.text import word_count
from filewarden.schema import THREAT
from filewarden.settings import ScanSettings
from filewarden.sources import catalogue as cat
from filewarden.sources.catalogue import Rule

_BYTES = "__bytes"  # content, one character per byte
_SEARCH = "__search"  # lower-cased content for substring tests
_WORK_PREFIX = "__"
_SHARED_GATES = ("_", "$")  # characters that many needles share


# --- building blocks --------------------------------------------------------


def _with_text(files: DataFrame, needles: Iterable[str]) -> DataFrame:
    """Files with readable content, its one-character-per-byte form and one flag per needle.

    A needle that contains another one is only searched where the shorter one occurs.
    """
    df = files.filter(F.col("content").isNotNull()).select(
        "*",
        bs.latin1(F.col("content")).alias(_BYTES),
        bs.search_text(F.col("content")).alias(_SEARCH),
    )
    for layer in _needle_layers(needles):
        flags = {}
        for needle, inner in layer.items():
            found = f"contains({_SEARCH}, {_text(needle)})"
            flags[_flag(needle)] = F.expr(found if inner is None else f"{_flag(inner)} AND {found}")
        df = _add(df, flags)
    return df


def _flag(needle: str) -> str:
    return f"{_WORK_PREFIX}has_{needle.encode().hex()}"


def _needle_layers(needles: Iterable[str]) -> list[dict[str, str | None]]:
    """Needles with the longest other needle they contain, in an order that has that one first."""
    wanted = set(needles)
    wanted |= {gate for gate in _SHARED_GATES if sum(gate in n for n in wanted) > 1}
    depth: dict[str, int] = {}
    inner: dict[str, str | None] = {}
    for needle in sorted(wanted, key=lambda n: (len(n), n)):
        inner[needle] = max((n for n in depth if n in needle), key=len, default=None)
        depth[needle] = 0 if inner[needle] is None else depth[inner[needle]] + 1
    return [{n: inner[n] for n in depth if depth[n] == level} for level in sorted(set(depth.values()))]


def _needles(groups: Iterable[Sequence[Sequence[str]]]) -> set[str]:
    return {needle for group in groups for any_of in group for needle in any_of}


def _text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _may_match(needles: Sequence[Sequence[str]]) -> str:
    """SQL condition: every group of needles has a member in the content."""
    groups = (" OR ".join(_flag(n) for n in any_of) for any_of in needles)
    return " AND ".join(f"({group})" for group in groups) or "TRUE"


def _work(rule: Rule, what: str) -> str:
    return f"{_WORK_PREFIX}{what}_{rule.rule_ord}"


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *[column.alias(name) for name, column in columns.items()])


def _sealed(df: DataFrame, kept: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Kept columns plus computed ones behind a generator.

    A filter on a computed column (`size(threats) > 0`, `is_obfuscated`) would
    otherwise be pushed through the projections, and every regex it depends on
    would be inlined and run again. A generator output cannot be pushed through.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.explode(F.array(values)).alias("__sealed")).select(*kept, "__sealed.*")


def _with_matches(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """First match of each rule ('' if none), its literal position and, for calls, its surroundings.

    Position and surroundings belong to the first literal copy of the matched
    text, which may lie before the place where the regex matched.
    """
    match = {_work(r, "m"): F.expr(_first_match(r)) for r in rules}
    position = {
        _work(r, "p"): F.expr(f"IF({_work(r, 'm')} != '', instr({_BYTES}, {_work(r, 'm')}), 0)") for r in rules
    }
    context = {_work(r, "c"): F.expr(_context(r)) for r in rules if r.layer == "function"}
    return _add(_add(_add(df, match), position), context)


def _first_match(rule: Rule) -> str:
    condition = _may_match(rule.needles)
    if rule.exists:
        condition += f" AND {_BYTES} RLIKE {_text(rule.exists)}"
    pattern, group = (rule.linear, 1) if rule.linear else (rule.pattern, 0)
    return f"IF({condition}, regexp_extract({_BYTES}, {_text(pattern)}, {group}), '')"


def _context(rule: Rule) -> str:
    """Bytes around a call: up to 100 before and after its match, clamped to the content."""
    match, position = _work(rule, "m"), _work(rule, "p")
    start = f"greatest({position} - {bs.CONTEXT_BYTES}, 1)"
    end = f"{position} + length({match}) + {bs.CONTEXT_BYTES}"
    return f"IF({position} = 0, '', substring({_BYTES}, {start}, {end} - {start}))"


def _line(position: str) -> str:
    """1-based line of a 1-based position; 0 when the position is 0 (absent)."""
    before = f"substring({_BYTES}, 1, {position} - 1)"
    return f"IF({position} = 0, 0, {position} - length(replace({before}, '\\n', '')))"


def _call_fired(rule: Rule) -> str:
    return " OR ".join(f"{_work(rule, 'c')} RLIKE {_text('(?d)' + p)}" for p in cat.FUNCTION_CONTEXT[rule.name])


def _call_confidence(rule: Rule) -> str:
    terms = [f"{cat.FUNCTION_BASE_CONFIDENCE}D"] + [
        f"IF({_work(rule, 'c')} RLIKE {_text('(?d)' + pattern)}, {weight}D, 0D)"
        for pattern, weight in cat.FUNCTION_CONFIDENCE_WEIGHTS
    ]
    return f"least({' + '.join(terms)}, 1D)"


def _regex_threat(rule: Rule, threshold: float | None) -> Column:
    """Threat of one regex rule, NULL where it did not fire or stays below the threshold.

    Rules are many and alike, so their expressions are SQL text: one parsed
    expression per rule instead of some fifty column calls.
    """
    fired, shown = f"{_work(rule, 'm')} != ''", _work(rule, "m")
    confidence = f"{rule.confidence}D"
    if rule.layer == "function":
        fired, shown, confidence = f"{fired} AND ({_call_fired(rule)})", _work(rule, "c"), _call_confidence(rule)
    if threshold is not None:
        fired = f"{fired} AND {confidence} >= {threshold}D"
    fields = {
        "rule_ord": str(rule.rule_ord),
        "layer": _text(rule.layer),
        "type": _text(rule.type),
        "severity": _text(rule.severity),
        "description": _text(rule.description),
        "confidence": confidence,
        "evidence": f"make_valid_utf8(CAST(encode(substring({shown}, 1, {bs.EVIDENCE_BYTES}), 'ISO-8859-1') AS STRING))",
        "line_number": _line(_work(rule, "p")),
        "source": "CAST(NULL AS STRING)",
    }
    values = ", ".join(f"'{f.name}', {fields[f.name]}" for f in THREAT.fields)
    return F.expr(f"IF({fired}, named_struct({values}), NULL)")


def threat_struct(
    rule_ord: int,
    layer: str,
    type_: str,
    severity: Column,
    description: Column,
    confidence: Column,
    evidence: Column,
    line_number: Column,
    source: Column | None = None,
) -> Column:
    values = {
        "rule_ord": F.lit(rule_ord),
        "layer": F.lit(layer),
        "type": F.lit(type_),
        "severity": severity,
        "description": description,
        "confidence": confidence,
        "evidence": evidence,
        "line_number": line_number,
        "source": F.lit(None) if source is None else source,
    }
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in THREAT.fields])


def _reachable(rules: Iterable[Rule], threshold: float | None) -> list[Rule]:
    """Rules that can still reach the threshold; the others need no expression at all."""
    return [r for r in rules if threshold is None or r.confidence is None or r.confidence >= threshold]


# --- scores -----------------------------------------------------------------


_HEX_NEEDLES = (("\\x",),)
_OBFUSCATION_NEEDLES = _needles([_HEX_NEEDLES, cat.DECODER_NEEDLES])
_BEHAVIOUR_NEEDLES = _needles(needles for needles, _ in cat.BEHAVIOUR_TESTS)


def _obfuscation_counts() -> dict[str, Column]:
    def counted(needles: Sequence[Sequence[str]], pattern: str) -> Column:
        return F.expr(f"IF({_may_match(needles)}, regexp_count({_BYTES}, {_text(pattern)}), 0)")

    runs = f"IF({_BYTES} RLIKE {_text(cat.LONG_RUN_BLOCK)}, regexp_count({_BYTES}, {_text(cat.LONG_RUN)}), 0)"
    return {
        "long_runs": F.expr(runs),
        "hex_escapes": counted(_HEX_NEEDLES, cat.HEX_ESCAPE),
        "decoder_names": counted(cat.DECODER_NEEDLES, "|".join(cat.DECODER_NAMES)),
    }


def _code_score(prefix: str = "") -> Column:
    """Score terms that come from counted code fragments, in their fixed order of addition."""
    return (
        F.col(f"{prefix}long_runs") * F.lit(cat.LONG_RUN_WEIGHT)
        + F.col(f"{prefix}hex_escapes") * F.lit(cat.HEX_ESCAPE_WEIGHT)
        + F.col(f"{prefix}decoder_names") * F.lit(cat.DECODER_WEIGHT)
    )


def _long_word_score(size: Column, words: Column) -> Column:
    return F.when(size / (words + 1) > cat.LONG_WORD_BYTES, F.lit(cat.LONG_WORD_WEIGHT)).otherwise(F.lit(0.0))


def _obfuscation_score_for_alert() -> Column:
    """The obfuscation score where it can pass the alert limit, else 0.

    Words are counted only for files where the long-word term can make the
    difference or changes an alert's confidence.
    """
    code = F.col("__code_score")
    size = F.length(F.col(_BYTES))
    full = F.least(code + _long_word_score(size, word_count(F.col(_BYTES))), F.lit(1.0))
    can_alert = code + F.lit(cat.LONG_WORD_WEIGHT) > F.lit(cat.OBFUSCATION_THRESHOLD)
    return F.when(can_alert, full).otherwise(F.lit(0.0))


def _behaviour_score() -> Column:
    terms = [
        f"IF({_may_match(needles)} AND {_BYTES} RLIKE {_text(test)}, {weight}D, 0D)"
        for (_, weight), (needles, test) in zip(cat.BEHAVIOURS, cat.BEHAVIOUR_TESTS)
    ]
    return F.expr(f"least({' + '.join(['0D', *terms])}, 1D)")


def entropy_confidence(entropy: Column) -> Column:
    return F.least((entropy - cat.ENTROPY_THRESHOLD) / 2, F.lit(1.0))


def _score_threat(
    rule_ord: int, kind: tuple[str, ...], fired: Column, confidence: Column, shown: Column, threshold: float | None
) -> Column:
    """Whole-file threat of a score, NULL where it did not fire or stays below the threshold."""
    type_, layer, severity, description, prefix = kind
    threat = threat_struct(
        rule_ord,
        layer,
        type_,
        F.lit(severity),
        F.lit(description),
        confidence,
        F.concat(F.lit(prefix), shown),
        F.lit(0),
    )
    return F.when(fired if threshold is None else fired & (confidence >= F.lit(threshold)), threat)


def _obfuscation_threat(score: Column, threshold: float | None) -> Column:
    shown = number_text(F.round(score, 2))
    fired = score > cat.OBFUSCATION_THRESHOLD
    return _score_threat(cat.OBFUSCATION_ORD, cat.OBFUSCATED, fired, score, shown, threshold)


def _entropy_threat(entropy: Column, threshold: float | None) -> Column:
    shown = F.regexp_replace(F.format_string("%.13f", entropy), r"\.?0+$", "")
    fired = entropy > cat.ENTROPY_THRESHOLD
    return _score_threat(cat.ENTROPY_ORD, cat.HIGH_ENTROPY, fired, entropy_confidence(entropy), shown, threshold)


def _behaviour_threat(score: Column, threshold: float | None) -> Column:
    shown = number_text(F.round(score, 2))
    fired = score > cat.BEHAVIOUR_THRESHOLD
    return _score_threat(cat.BEHAVIOUR_ORD, cat.MALICIOUS, fired, score, shown, threshold)


# --- ranking ----------------------------------------------------------------


def ranked(threats: Column) -> Column:
    """Threats of one file by severity, then confidence (both descending), then rule order."""
    keyed = F.transform(
        threats,
        lambda t: F.struct(
            (-severity_rank(t["severity"])).alias("severity_key"),
            (-t["confidence"]).alias("confidence_key"),
            t["rule_ord"].alias("rule_key"),
            t.alias("threat"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["threat"])


def explode_threats(analysed: DataFrame) -> DataFrame:
    """One row per threat with its rank in the file (1 = worst)."""
    kept = [c for c in analysed.columns if c != "threats"]
    return analysed.select(*kept, F.posexplode("threats").alias("position", "threat")).select(
        *kept, "threat.*", (F.col("position") + 1).alias("rank")
    )


def top_threat(analysed: DataFrame) -> DataFrame:
    """The worst threat of each file that has one."""
    kept = [c for c in analysed.columns if c != "threats"]
    return analysed.filter(F.size("threats") > 0).select(*kept, F.element_at("threats", 1).alias("threat")).select(
        *kept, "threat.*"
    )


def drop_below(threats: Column, threshold: float) -> Column:
    return F.filter(threats, lambda t: t["confidence"] >= F.lit(threshold))


# --- the whole analysis -----------------------------------------------------


def local_threats(
    files: DataFrame,
    signatures: Sequence[Rule] | None = None,
    settings: ScanSettings = ScanSettings(),
) -> DataFrame:
    """All local layers per file: `files` columns without content, plus `file_hash` and `threats`.

    Threats are filtered by the confidence threshold and stand in rule order.
    """
    threshold = settings.threshold
    signatures = cat.default_signatures() if signatures is None else signatures
    leading = _reachable([*sorted(signatures, key=lambda r: r.rule_ord), *cat.function_rules(), *cat.HEURISTICS], threshold)
    patterns = _reachable(cat.PATTERNS, threshold)
    with_entropy = cat.MAX_ENTROPY_CONFIDENCE >= threshold

    rules = [*leading, *patterns]
    df = _with_text(files, _needles(r.needles for r in rules) | _OBFUSCATION_NEEDLES | _BEHAVIOUR_NEEDLES)
    work = {f"__{name}": column for name, column in _obfuscation_counts().items()}
    work["__behaviour"] = _behaviour_score()
    work["file_hash"] = F.sha2("content", 256)
    if with_entropy:
        work["__entropy"] = byte_entropy(F.col("content"))
    df = _add(df, work)
    df = _add(df, {"__code_score": _code_score("__")})
    df = _add(df, {"__obfuscation": _obfuscation_score_for_alert()})
    df = _with_matches(df, rules)

    threats = [_regex_threat(rule, threshold) for rule in leading]
    threats.append(_obfuscation_threat(F.col("__obfuscation"), threshold))
    if with_entropy:
        threats.append(_entropy_threat(F.col("__entropy"), threshold))
    threats += [_regex_threat(rule, threshold) for rule in patterns]
    threats.append(_behaviour_threat(F.col("__behaviour"), threshold))
    kept = [c for c in files.columns if c != "content"]
    return _sealed(df, [*kept, "file_hash"], {"threats": F.array_compact(F.array(*threats))})


# --- single layers ----------------------------------------------------------


def _rule_hits(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    df = _with_matches(_with_text(files, _needles(r.needles for r in rules)), rules)
    kept = [c for c in files.columns if c != "content"]
    hits = F.array_compact(F.array(*[_regex_threat(rule, None) for rule in rules]))
    return df.select(*kept, F.inline(hits))


def signature_hits(files: DataFrame, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """First match of every catalogue signature."""
    return _rule_hits(files, cat.default_signatures() if signatures is None else list(signatures))


def function_hits(files: DataFrame) -> DataFrame:
    """Suspicious calls: a watched function whose surroundings look hostile."""
    return _rule_hits(files, cat.function_rules())


def heuristic_hits(files: DataFrame) -> DataFrame:
    """Raw user input and dynamic includes."""
    return _rule_hits(files, cat.HEURISTICS)


def pattern_hits(files: DataFrame) -> DataFrame:
    """Literal-and-replace, variable concatenation and character-building loops."""
    return _rule_hits(files, cat.PATTERNS)


def obfuscation_scores(files: DataFrame) -> DataFrame:
    """Obfuscation score of every file with its terms and band."""
    kept = [c for c in files.columns if c != "content"]
    df = _add(_with_text(files, _OBFUSCATION_NEEDLES), {**_obfuscation_counts(), "words": word_count(F.col(_BYTES))})
    long_words = _long_word_score(F.length(F.col(_BYTES)), F.col("words"))
    score = F.least(_code_score() + long_words, F.lit(1.0))
    terms = {name: F.col(name) for name in ("long_runs", "hex_escapes", "decoder_names", "words")}
    return _sealed(df, kept, {**terms, "obfuscation_score": score}).select(
        "*",
        obfuscation_band(F.col("obfuscation_score")).alias("obfuscation_band"),
        (F.col("obfuscation_score") > cat.OBFUSCATION_THRESHOLD).alias("is_obfuscated"),
    )


def behaviour_scores(files: DataFrame) -> DataFrame:
    """Behaviour score of every file."""
    kept = [c for c in files.columns if c != "content"]
    df = _sealed(_with_text(files, _BEHAVIOUR_NEEDLES), kept, {"behaviour_score": _behaviour_score()})
    return df.select("*", (F.col("behaviour_score") > cat.BEHAVIOUR_THRESHOLD).alias("is_malicious"))


def entropy_scores(files: DataFrame) -> DataFrame:
    """Byte entropy of every file, its band and the alert confidence where it alerts."""
    kept = [c for c in files.columns if c != "content"]
    df = files.filter(F.col("content").isNotNull()).select(*kept, byte_entropy(F.col("content")).alias("entropy"))
    alert = F.col("entropy") > cat.ENTROPY_THRESHOLD
    return df.select(
        "*",
        entropy_band(F.col("entropy")).alias("entropy_band"),
        F.when(alert, entropy_confidence(F.col("entropy"))).alias("alert_confidence"),
    )


def byte_histogram(files: DataFrame) -> DataFrame:
    """One row per file and byte value that occurs (at most 256 per file), without a shuffle."""
    kept = [c for c in files.columns if c != "content"]
    counted = files.filter(F.col("content").isNotNull()).select(*kept, byte_counts(F.col("content")).alias("counts"))
    return counted.select(*kept, F.posexplode("counts").alias("byte_value", "n")).filter("n > 0")


def histogram_entropy(files: DataFrame) -> DataFrame:
    """Entropy from the byte histogram, computed by Spark expressions."""
    kept = [c for c in files.columns if c != "content"]
    counted = files.filter(F.col("content").isNotNull()).select(*kept, byte_counts(F.col("content")).alias("counts"))
    return counted.select(*kept, entropy_of_counts(F.col("counts")).alias("entropy"))
