"""Detection rules: the signature catalogue (a table) and the fixed rule layers.

Signature patterns are Perl-style and delimited (``/.../i``) because that is how
users of the catalogue write them; :func:`java_regex` turns them into the regex
dialect of Spark's built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewarden import schema

# Numbers of a layer's rules start here, so rule_ord orders threats layer by layer.
SIGNATURE_ORD = 1
FUNCTION_ORD = 100_000
HEURISTIC_ORD = 101_000
OBFUSCATION_ORD = 102_000
ENTROPY_ORD = 103_000
PATTERN_ORD = 104_000
BEHAVIOUR_ORD = 105_000
MODEL_ORD = 106_000
REPUTATION_ORD = 107_000

# A byte that cannot precede a word start. `\b` is not used: on one-char-per-byte
# text Java would take Latin-1 letters for word characters.
WORD_START = "(?<![A-Za-z0-9_])"


@dataclass(frozen=True)
class Rule:
    """One regex rule that emits at most one threat per file.

    `needles` is a cheap necessary condition on the lower-cased content: each
    inner tuple must have at least one member present. Empty means unknown.
    Needles are fragments that start with an uncommon byte, because a substring
    search stops at every occurrence of the first one.

    Patterns with `.*` may need quadratic or cubic time on long lines. `linear`,
    if given, finds the same first match in linear time as its group 1; `exists`
    matches exactly the same contents as `pattern` and is tested before it.
    """

    rule_ord: int
    layer: str
    type: str
    pattern: str
    severity: str
    description: str
    confidence: float | None
    needles: tuple[tuple[str, ...], ...] = ()
    name: str = ""
    exists: str = ""
    linear: str = ""


def line_anchored(head: str, inline_head: str, rest: str, flags: str = "dm") -> str:
    """First match of `head` + `rest` (as group 1), trying `rest` once per line.

    `rest` stays on the line where the head ends, so if it fails after the first head
    of a line it fails after all of them. `inline_head` is the head without line
    ends; a head that spans lines is the last one of its line and gets its own try.
    """
    return rf"(?{flags})(?:^(?>.*?(?={inline_head}))|(?!{inline_head})(?={head}))({head}{rest})"



# ---------------------------------------------------------------------------
# Default signatures (name, pattern, severity, description).
# ---------------------------------------------------------------------------
SIGNATURES = (
    ("eval_obfuscation", r"/eval\s*\(\s*base64_decode\s*\(/", "high", "Obfuscated eval with base64 decode"),
    (
        "file_inclusion",
        r"/include\s*\(\s*\$_[GET|POST|REQUEST]/",
        "critical",
        "Dynamic file inclusion vulnerability",
    ),
    (
        "shell_exec",
        r"/shell_exec\s*\(\s*\$_[GET|POST|REQUEST]/",
        "critical",
        "Shell command execution from user input",
    ),
    ("backdoor_pattern", r"/c99|r57|wso|b374k|FilesMan|WSO/i", "critical", "Common backdoor shell names"),
    (
        "base64_suspicious",
        r"""/base64_decode\s*\(\s*['"][A-Za-z0-9+\/=]{100,}['"]/""",
        "medium",
        "Suspicious base64 encoded content",
    ),
    ("crypto_mining", r"/coinhive|cryptonight|monero|stratum\+tcp/i", "high", "Cryptocurrency mining code"),
    ("sql_injection", r"/union\s+select.*from.*information_schema/i", "high", "SQL injection attempt"),
    (
        "wordpress_exploit",
        r"/wp_users.*password.*md5|wp_options.*siteurl.*update/i",
        "critical",
        "WordPress database manipulation",
    ),
)
SIGNATURE_CONFIDENCE = 0.9

# Necessary substrings of the default signatures, keyed by pattern: a catalogue
# entry with another pattern is always evaluated.
SIGNATURE_NEEDLES = {
    r"/eval\s*\(\s*base64_decode\s*\(/": (("64_decode",), ("val",)),
    r"/include\s*\(\s*\$_[GET|POST|REQUEST]/": (("$_",), ("clude",)),
    r"/shell_exec\s*\(\s*\$_[GET|POST|REQUEST]/": (("_exec",), ("$_",)),
    r"/c99|r57|wso|b374k|FilesMan|WSO/i": (("99", "57", "wso", "374k", "filesman"),),
    r"""/base64_decode\s*\(\s*['"][A-Za-z0-9+\/=]{100,}['"]/""": (("64_decode",),),
    r"/coinhive|cryptonight|monero|stratum\+tcp/i": (("coinhive", "yptonight", "monero", "+tcp"),),
    r"/union\s+select.*from.*information_schema/i": (("_schema",), ("union",)),
    r"/wp_users.*password.*md5|wp_options.*siteurl.*update/i": (("_users", "_options"), ("wp_",)),
}

# `.*A.*B` spelled per line with atomic parts: the first A of a line, the first B after it, and so on.
SIGNATURE_EXISTS = {
    r"/wp_users.*password.*md5|wp_options.*siteurl.*update/i": (
        r"(?dim)^(?>.*?wp_users)(?>.*?password).*?md5|^(?>.*?wp_options)(?>.*?siteurl).*?update"
    ),
}

# The greedy match ends at the last `information_schema` of the line, given a `from` before one.
def line_alternatives(first: tuple[str, str, str], second: tuple[str, str, str]) -> str:
    """First match of `a.*b.*c` of either of two triples of plain texts (as group 1), in linear time per line.

    A line matches a triple if its first `a`, the first `b` behind and the first `c` behind that exist; the match then
    starts at the first `a` and ends at the last `c`. A line that matches both starts with whichever comes first.
    """
    has = [rf"(?=(?>.*?{a})(?>.*?{b}).*?{c})" for a, b, c in (first, second)]
    to = lambda *heads: rf"(?>.*?(?={'|'.join(heads)}))"
    starts = f"{has[0]}{has[1]}{to(first[0], second[0])}|{has[0]}{to(first[0])}|{has[1]}{to(second[0])}"
    return rf"(?dim)^(?>{starts})({first[0]}.*{first[2]}|{second[0]}.*{second[2]})"


SIGNATURE_LINEAR = {
    r"/wp_users.*password.*md5|wp_options.*siteurl.*update/i": line_alternatives(
        ("wp_users", "password", "md5"), ("wp_options", "siteurl", "update")
    ),
    r"/union\s+select.*from.*information_schema/i": line_anchored(
        r"union\s+select",
        r"union[^\S\n]+select",
        r"(?=(?>.*?from).*?information_schema).*information_schema",
        "dim",
    ),
}

# Function names watched by the heuristic layer and their severity.
FUNCTION_SEVERITY = {
    "eval": "high",
    "exec": "high",
    "shell_exec": "high",
    "system": "high",
    "passthru": "high",
    "file_get_contents": "medium",
    "file_put_contents": "medium",
    "fopen": "medium",
    "fwrite": "medium",
    "curl_exec": "medium",
    "base64_decode": "low",
    "str_rot13": "low",
    "gzinflate": "medium",
    "gzuncompress": "medium",
}

# What the surroundings of a call must contain (any one pattern).
# A watched function without an entry never raises a threat.
_USER_INPUT_CONTEXT = (r"\$_(?:GET|POST|REQUEST)",)
FUNCTION_CONTEXT = {
    "eval": (r"eval\s*\(\s*\$", r"base64_decode"),
    "exec": _USER_INPUT_CONTEXT,
    "shell_exec": _USER_INPUT_CONTEXT,
    "system": _USER_INPUT_CONTEXT,
    "file_get_contents": (r"https?://",),
    "base64_decode": (r"""base64_decode\s*\(\s*["'][A-Za-z0-9+/=]{50,}""",),
}

# Necessary fragments of the calls that can raise a threat.
FUNCTION_NEEDLES = {
    "eval": (("val",), ("eval",)),
    "exec": (("xec",),),
    "shell_exec": (("_exec",),),
    "system": (("ystem",),),
    "file_get_contents": (("_get_contents",),),
    "base64_decode": (("64_decode",),),
}

# Call confidence, a base plus weights for what the surroundings contain.
FUNCTION_BASE_CONFIDENCE = 0.5
FUNCTION_CONFIDENCE_WEIGHTS = (
    (r"\$_(?:GET|POST|REQUEST)", 0.3),
    (r"base64_decode|str_rot13|gzinflate", 0.2),
    (r"eval|exec|system", 0.4),
)

# The remaining regex rules.
HEURISTICS = (
    Rule(
        HEURISTIC_ORD,
        "heuristic",
        "user_input",
        r"(?d)\$_(?:GET|POST|REQUEST|COOKIE)\s*\[.*?\]",
        "medium",
        "Direct usage of user input without sanitization",
        0.6,
        (("$_",), ("[",)),
        linear=line_anchored(
            r"\$_(?:GET|POST|REQUEST|COOKIE)\s*\[", r"\$_(?:GET|POST|REQUEST|COOKIE)[^\S\n]*\[", r".*?\]"
        ),
    ),
    Rule(
        HEURISTIC_ORD + 1,
        "heuristic",
        "dynamic_include",
        r"(?d)(?:include|require)(?:_once)?\s*\(\s*\$",
        "high",
        "Dynamic file inclusion with variable",
        0.8,
        (("$",), ("quire", "clude")),
    ),
)
PATTERNS = (
    Rule(
        PATTERN_ORD,
        "pattern",
        "suspicious_pattern",
        r"""(?d)\$[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*["'][^"']*["'];\s*\$[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*str_replace""",
        "medium",
        "String replacement pattern commonly used in malware",
        0.7,
        (("_replace",), ("$",)),
    ),
    Rule(
        PATTERN_ORD + 1,
        "pattern",
        "suspicious_pattern",
        r"(?d)\$[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*\$[a-zA-Z_][a-zA-Z0-9_]*\s*\.\s*\$[a-zA-Z_][a-zA-Z0-9_]*",
        "low",
        "Variable concatenation pattern",
        0.4,
        (("$",), ("=",), (".",)),
    ),
    Rule(
        PATTERN_ORD + 2,
        "pattern",
        "suspicious_pattern",
        r"(?d)for\s*\(\s*\$[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*0.*?chr\s*\(",
        "high",
        "Character building loop commonly used in obfuscation",
        0.8,
        (("$",), ("chr",), ("for",)),
        linear=line_anchored(
            r"for\s*\(\s*\$[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*0",
            r"for[^\S\n]*\([^\S\n]*\$[a-zA-Z_][a-zA-Z0-9_]*[^\S\n]*=[^\S\n]*0",
            r".*?chr\s*\(",
        ),
    ),
)

# Behaviour patterns in summation order (pattern, weight).
BEHAVIOURS = (
    (r"(?d)wp_users.*password", 0.4),
    (r"(?d)admin.*user.*add", 0.3),
    (r"""(?d)file_get_contents\s*\(\s*["']https?://""", 0.2),
    (r"(?di)curl.*exec.*post", 0.3),
    (r"(?d)mail\s*\(.*@.*\)", 0.1),
    (r"""(?d)\$_SERVER\s*\[\s*["']HTTP_""", 0.2),
)
# How each behaviour is tested: needles, and the same condition in linear time (only existence counts).
BEHAVIOUR_TESTS = (
    ((("_users",), ("password",)), r"(?dm)^(?>.*?wp_users).*?password"),
    ((("dmin",), ("user",), ("add",)), r"(?dm)^(?>.*?admin)(?>.*?user).*?add"),
    ((("_get_contents",), ("://",)), BEHAVIOURS[2][0]),
    ((("xec",), ("curl",), ("post",)), r"(?dim)^(?>.*?curl)(?>.*?exec).*?post"),
    (
        (("@",), ("mail",), (")",)),
        r"(?dm)^(?>.*?mail[^\S\n]*\()(?>.*?@).*?\)|mail[^\S\n]*\n\s*\((?>.*?@).*?\)",
    ),
    ((("$_server",), ("http_",)), BEHAVIOURS[5][0]),
)
BEHAVIOUR_THRESHOLD = 0.6

# Obfuscation score terms and limits.
LONG_RUN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{50,}+"  # possessive and anchored: no retry inside a run
# Any run of 50 covers one of the 25-byte blocks counted from the start: a cheap test before counting.
LONG_RUN_BLOCK = r"(?s)\A(?:.{25})*?[A-Za-z0-9+/=]{25}"
HEX_ESCAPE = r"\\x[0-9A-Fa-f]{2}"
DECODER_NAMES = ("str_rot13", "base64_decode", "gzinflate", "gzuncompress")
DECODER_NEEDLES = (("_rot13", "64_decode", "zinflate", "zuncompress"),)
LONG_RUN_WEIGHT = 0.1
HEX_ESCAPE_WEIGHT = 0.05
DECODER_WEIGHT = 0.2
LONG_WORD_WEIGHT = 0.3
LONG_WORD_BYTES = 20
OBFUSCATION_THRESHOLD = 0.7

# Entropy alert limit and the largest confidence it can reach (8 bits).
ENTROPY_THRESHOLD = 7.5
MAX_ENTROPY_CONFIDENCE = 0.25

# Threats raised by scores (type, layer, severity, description, evidence prefix).
OBFUSCATED = (
    "obfuscated_code",
    "heuristic",
    "medium",
    "Heavily obfuscated code detected",
    "High obfuscation score: ",
)
HIGH_ENTROPY = (
    "high_entropy",
    "statistical",
    "medium",
    "High entropy content suggesting encryption or obfuscation",
    "Entropy score: ",
)
MALICIOUS = (
    "malicious_behavior",
    "statistical",
    "high",
    "Code exhibits malicious behavioral patterns",
    "Behavioral analysis score: ",
)

_FLAG_MAP = {"i": "i", "s": "s", "m": "m", "x": "x"}
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


def java_regex(pattern: str) -> str:
    """Delimited Perl-style pattern to a Java regex with byte semantics.

    `.` and line anchors know only `\\n` as a line end, and `\\b` is spelled out
    as an ASCII word boundary.
    """
    closing = _CLOSING.get(pattern[0], pattern[0])
    end = pattern.rindex(closing)
    if end == 0 or pattern[0].isalnum() or pattern[0] == "\\":
        raise ValueError(f"pattern is not delimited: {pattern!r}")
    body, modifiers = pattern[1:end], pattern[end + 1 :]
    unknown = set(modifiers) - set(_FLAG_MAP)
    if unknown:
        raise ValueError(f"unsupported pattern modifiers {sorted(unknown)} in {pattern!r}")
    word = "[A-Za-z0-9_]"
    boundary = rf"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    body = re.sub(r"\\(.)", lambda m: boundary if m[1] == "b" else m[0], body, flags=re.S)
    return "(?d" + "".join(_FLAG_MAP[m] for m in modifiers) + ")" + body


def signature_rule(position: int, name: str, pattern: str, severity: str, description: str, confidence: float) -> Rule:
    return Rule(
        SIGNATURE_ORD + position,
        "signature",
        name,
        java_regex(pattern),
        severity,
        description,
        confidence,
        SIGNATURE_NEEDLES.get(pattern, ()),
        name,
        SIGNATURE_EXISTS.get(pattern, ""),
        SIGNATURE_LINEAR.get(pattern, ""),
    )


def default_signatures() -> list[Rule]:
    return [
        signature_rule(i, name, pattern, severity, text, SIGNATURE_CONFIDENCE)
        for i, (name, pattern, severity, text) in enumerate(SIGNATURES)
    ]


def function_rules() -> list[Rule]:
    """Call rules of the watched functions that can raise a threat at all."""
    return [
        Rule(
            FUNCTION_ORD + i,
            "function",
            "suspicious_function",
            rf"(?di){WORD_START}{re.escape(name)}\s*\(",
            severity,
            f"Suspicious usage of function: {name}",
            None,
            FUNCTION_NEEDLES[name],
            name,
        )
        for i, (name, severity) in enumerate(FUNCTION_SEVERITY.items())
        if name in FUNCTION_CONTEXT
    ]


def default_catalogue(spark: SparkSession) -> DataFrame:
    """The default signatures as a `rules` table."""
    rows = [
        (SIGNATURE_ORD + i, "signature", name, pattern, severity, text, SIGNATURE_CONFIDENCE)
        for i, (name, pattern, severity, text) in enumerate(SIGNATURES)
    ]
    return spark.createDataFrame(rows, schema.RULES)


def collect_catalogue(rules: DataFrame) -> list[Rule]:
    """Rules on the driver, where the scan plan is built from them (a few hundred rows at most)."""
    return [
        signature_rule(
            row["rule_ord"] - SIGNATURE_ORD,
            row["name"],
            row["pattern"],
            row["severity"],
            row["description"],
            SIGNATURE_CONFIDENCE if row["confidence"] is None else row["confidence"],
        )
        for row in rules.select("rule_ord", "name", "pattern", "severity", "description", "confidence")
        .orderBy("rule_ord")
        .collect()
    ]


def merge_catalogue(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates replace rules of the same name in place; new names follow in update order.

    Of several updates with one name the last one counts, so a name stays one rule.
    """
    values = [name for name in updates.columns if name != "name"]
    newest = F.max_by(F.struct(*values), "rule_ord").alias("rule")
    updates = updates.groupBy("name").agg(newest).select("name", "rule.*").select(*updates.columns)
    fields = [name for name in schema.RULES.fieldNames() if name not in ("rule_ord", "name")]
    last = current.agg(F.coalesce(F.max("rule_ord"), F.lit(SIGNATURE_ORD - 1))).scalar()
    first_update = updates.agg(F.min("rule_ord")).scalar()
    old, new = current.alias("old"), updates.alias("new")
    appended_ord = last + 1 + F.col("new.rule_ord") - first_update
    return old.join(new, "name", "full_outer").select(
        F.coalesce("old.rule_ord", appended_ord).cast("int").alias("rule_ord"),
        F.when(F.col("new.rule_ord").isNotNull(), F.col("new.layer")).otherwise(F.col("old.layer")).alias("layer"),
        "name",
        *[
            F.when(F.col("new.rule_ord").isNotNull(), F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f)
            for f in fields
            if f != "layer"
        ],
    )


def rule_count(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("rule_count"))
