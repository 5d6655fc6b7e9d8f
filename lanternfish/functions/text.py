"""Expressions over strings: entropy, placeholders, masks, checks of form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules as R

# Values that are examples, not credentials.
EXAMPLES = ("AKIA" + "IOSFODNN7EXAMPLE", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")
PLACEHOLDER_WORDS = ("example", "dummy", "notasecret", "not_a_secret", "test123", "sample_key", "todo", "fixme")
PLACEHOLDER_FORMS = (
    r"^(?:your[_-]?(?:api[_-]?key|key|secret|token)|replace[_-]?me|placeholder|change[_-]?me|insert[_-]?key)(?:[_-]here|[_-]x+)*$",
    r"^(?:sk|rk|pk)_(?:live|test)_x+$",
)
BODY_PREFIX = R.BODY
#: Levels of severity, lowest first.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def either(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string. A character is counted by what the value lacks without it."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.filter(F.array_distinct(F.split(value, "")), lambda c: c != ""), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))


def repeats_unit(value: Column) -> Column:
    """Whether a unit of one to four characters makes up the value, four times or more."""
    return F.regexp_like(value, F.lit(r"^(.{1,4})\1{3,}$"))


def distinct_characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))


def placeholder(value: Column, with_repeats: bool = True) -> Column:
    folded = F.lower(F.trim(value))
    dull = distinct_characters(value) <= 2
    if with_repeats:
        dull = dull | repeats_unit(value)
    return value.isin(*EXAMPLES) | either(folded.rlike(p) for p in PLACEHOLDER_FORMS) | ((F.length(value) > 7) & dull) | folded.isin(*PLACEHOLDER_WORDS)


def mask(value: Column) -> Column:
    """The value's known prefix and how many characters follow, never the characters."""
    kept = [F.when(F.startswith(value, F.lit(p)), F.concat(F.lit(p), F.when(F.length(value) > len(p), F.concat(F.lit("[REDACTED_"), F.length(value) - len(p), F.lit("_CHARS]"))).otherwise(""))) for p in R.KNOWN_PREFIXES]
    return F.coalesce(*kept, F.lit("[REDACTED_SECRET]"))


def fingerprint(rule: Column, value: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", rule, value), 256), F.lit(32))


def risk(severity: Column, bits: Column, confidence: Column) -> Column:
    base = F.lit(R.BASE_RISK["LOW"])
    for s in ("MEDIUM", "HIGH", "CRITICAL"):
        base = F.when(severity == s, R.BASE_RISK[s]).otherwise(base)
    return base * 0.4 + F.least(bits / 8.0, F.lit(1.0)) * 0.3 + confidence * 0.3


def adjusted_severity(severity: Column, bits: Column, risk_score: Column) -> Column:
    """A level up for entropy over 4 and for risk over 0.8, one down for risk under 0.3, within the levels at every step."""
    top = len(SEVERITIES) - 1
    level = F.greatest(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1, F.lit(0))
    level = F.least(level + (bits > 4.0).cast("int"), F.lit(top))
    level = F.least(level + (risk_score > 0.8).cast("int"), F.lit(top))
    level = F.greatest(level - (risk_score < 0.3).cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), level + 1)


def redacted(line: Column, value: Column, shown: Column) -> Column:
    """The line with the value masked, as it is and as it stands in URLs. Values under two characters stay."""
    v = F.trim(value)
    quoted = F.replace(F.replace(F.url_encode(v), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    out = F.replace(line, v, shown)
    return F.when(F.length(v) >= 2, F.when(quoted != v, F.replace(out, quoted, shown)).otherwise(out)).otherwise(line)


def luhn(digits: Column) -> Column:
    """Luhn's check on 13 to 19 digits."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ipv4(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (F.try_to_number(p, F.lit("999")) <= 255))


def jwt(value: Column) -> Column:
    """Three parts, the last not empty, the first two JSON objects in base64url, a string `alg` in the first."""
    parts = F.split(value, r"\.")
    def decoded(i):
        p = F.translate(F.get(parts, F.lit(i)), "-_", "+/")
        pad = F.repeat(F.lit("="), F.pmod(-F.length(p), F.lit(4)))
        return F.try_to_binary(F.concat(p, pad), F.lit("base64")).cast("string")
    head, body = decoded(0), decoded(1)
    is_object = lambda s: F.json_object_keys(s).isNotNull()
    return (F.size(parts) == 3) & (F.length(F.get(parts, F.lit(2))) > 0) & (F.length(value) <= 16384) & is_object(head) & is_object(body) & F.coalesce(F.get_json_object(head, "$.alg").isNotNull() & head.rlike(r'"alg"\s*:\s*"'), F.lit(False))


def context(text: Column, value: Column, width: int = 50) -> Column:
    """The value's first occurrence with `width` characters on each side, white space collapsed."""
    at = F.instr(text, value)
    start = F.greatest(at - width, F.lit(1))
    raw = F.substr(text, start, at + F.length(value) + width - start)
    return F.when(at > 0, F.trim(F.regexp_replace(raw, r"\s+", " "))).otherwise("")


def line_of(text: Column, value: Column) -> Column:
    """Number, from 1, of the line where the value first occurs; null if it does not."""
    at = F.instr(text, value)
    return F.when(at > 0, F.size(F.split(F.substr(text, F.lit(1), at - 1), "\n"))).cast("int")


def lines_around(text: Column, line: Column, before: int, after: int) -> Column:
    parts = F.split(text, "\n")
    start = F.greatest(line - before, F.lit(1))
    return F.array_join(F.slice(parts, start, F.least(line + after, F.size(parts)) - start + 1), "\n")


def display_type(rule: Column) -> Column:
    return F.initcap(F.replace(rule, F.lit("_"), F.lit(" ")))


def normalized_content(text: Column) -> Column:
    """Hash of the text without blank lines and the lines' outer white space."""
    lines = F.transform(F.split(F.replace(F.trim(text), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    return F.sha2(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary or string message as lowercase hex; the key's pads are made here."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def normalized_secret(rule: Column, value: Column) -> Column:
    """Outer white space and one pair of equal quotes go; line ends of private keys become \\n."""
    v = F.trim(value)
    first, last = F.left(v, F.lit(1)), F.right(v, F.lit(1))
    v = F.when((F.length(v) >= 2) & (first == last) & first.isin('"', "'", "`"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.when(rule.contains("private") & rule.contains("key"), F.regexp_replace(v, "\r\n?", "\n")).otherwise(v)
