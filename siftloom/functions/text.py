"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk patterns as (reason, pattern, weight).
RISK_PATTERNS: tuple[tuple[str, str, int], ...] = (
    ("ignore_previous_instructions", r"ignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|preceding|earlier)\s+(?:instructions?|prompts?|messages?|directions?|context)", 3),
    ("disregard_instructions", r"disregard\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|preceding|earlier|all)\s+(?:instructions?|prompts?|messages?|rules?|directions?)", 3),
    ("forget_instructions", r"forget\s+(?:all\s+|everything\s+)?(?:previous|prior|above|your)?\s*(?:instructions?|prompts?|rules?|context|what you were told)", 3),
    ("override_instructions", r"override\s+(?:all\s+|any\s+|the\s+|your\s+)?(?:previous|prior|system\s+)?(?:instructions?|prompts?|rules?|settings?|guard)", 2),
    ("system_prompt_reference", r"(?:system\s+prompt|system\s+message|reveal\s+(?:your\s+)?(?:system\s+)?prompt|print\s+(?:your\s+)?(?:system\s+)?prompt|what\s+is\s+your\s+system\s+prompt)", 2),
    ("role_reassignment", r"you\s+are\s+now\s+(?:a\s+|an\s+|the\s+)?\w+", 2),
    ("new_instructions", r"(?:new|updated|revised|the\s+following)\s+instructions?\s*[:\-]", 2),
    ("act_as_jailbreak", r"(?:act\s+as|pretend\s+to\s+be|behave\s+as)\s+(?:a\s+|an\s+|if\s+|though\s+)?(?:dan|developer\s+mode|jailbroken|unrestricted|an?\s+ai\s+(?:that|without))", 3),
    ("do_anything_now", r"\bdo\s+anything\s+now\b|\bDAN\s+mode\b", 3),
    ("instruction_override_marker", r"###\s*(?:system|instruction|admin|override)|<\s*/?\s*(?:system|instructions?)\s*>", 2),
    ("exfiltration_request", r"(?:reveal|expose|leak|print|repeat)\s+(?:your\s+|the\s+|all\s+)?(?:secret|api\s+key|credentials?|password|hidden\s+instructions?)", 2),
)

# Named credentials in the order in which they are masked.
CREDENTIAL_PATTERNS: tuple[tuple[str, str], ...] = (
    (
        "api_key",
        r"(?<![A-Za-z0-9_])(?:sk-proj-[A-Za-z0-9_-]{20,}|sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{20,}|sk_test_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}"
        r"|ghp_[A-Za-z0-9]{36}|gh[oisur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})",
    ),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?![A-Za-z0-9_-])"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    ("connection_string", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|rediss|amqp|amqps|mssql)://[^\s:/@'\"]+:[^\s@'\"]+@[^\s'\"]+"),
)
OPAQUE_TOKEN, OPAQUE_BITS = r"[A-Za-z0-9+/_=-]{24,}", 3.0

# Words without content.
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with as is are was were be been being this that these those it its from into over under than so such "
    "no not do does did has have had will would can could should may might must we you they he she i me my our your their his her them"
).split()
STRONG, WEAK = 0.6, 0.25


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimate_tokens(text: str | Column) -> Column:
    """The larger of 1.3 per word and a quarter per character, rounded up; 0 for empty and null."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.ceil(F.greatest(F.regexp_count(t, F.lit(r"(?U)\S+")) * F.lit(1.3), F.length(t) / F.lit(4.0))).cast("long")


def content_hash(text: str | Column) -> Column:
    return F.sha2(_c(text).cast("binary"), 256)


def chunk_uuid(*parts: str | Column) -> Column:
    """The name-based (version 5, DNS) UUID of the parts joined by ``:``."""
    name = F.concat_ws(":", *(_c(p).cast("string") for p in parts))
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        F.substr(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def namespace(kind: str, value: str | Column) -> Column:
    """``Workspace_`` or ``User_`` and the value's bytes in base 32 without padding."""
    if kind not in ("Workspace", "User"):
        raise ValueError(f"no namespace {kind!r}")
    bits = F.regexp_replace(F.hex(_c(value).cast("binary")), "(.)", "$1 ")
    fours = F.transform(F.filter(F.split(bits, " "), lambda h: h != ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0"))
    flat = F.array_join(fours, "")
    padded = F.rpad(flat, (F.ceil(F.length(flat) / 5) * 5).cast("int"), F.lit("0"))
    fives = F.filter(F.split(F.regexp_replace(padded, "(.{5})", "$1 "), " "), lambda b: b != "")
    letters = F.array_join(F.transform(fives, lambda b: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(b, 2, 10).cast("int") + 1, F.lit(1))), "")
    return F.concat(F.lit(f"{kind}_"), letters)


def sanitise_url(url: str | Column) -> Column:
    """The trimmed URL if it has at most 2000 characters, the scheme http or https and a host, else null."""
    u = F.regexp_replace(_c(url), r"(?U)^\s+|\s+$", "")
    return F.when((F.length(u) <= 2000) & u.rlike(r"(?i)^https?://[^/?#\s]"), u)


#: Lower-case pieces of which a text must have one for a risk pattern to match; they spare most texts the pattern.
RISK_ANCHORS = {
    "ignore_previous_instructions": ("ignore",), "disregard_instructions": ("disregard",), "forget_instructions": ("forget",), "override_instructions": ("override",),
    "system_prompt_reference": ("prompt", "system"), "role_reassignment": ("now",), "new_instructions": ("instruction",), "act_as_jailbreak": ("act", "pretend", "behave"),
    "do_anything_now": ("anything", "dan"), "instruction_override_marker": ("###", "<"), "exfiltration_request": ("reveal", "expose", "leak", "print", "repeat"),
}


def risk(text: str | Column) -> Column:
    """A struct (level, reasons): each pattern is tried once, and only where one of its anchors stands.

    level: none, low (weights of the matches sum to 1 or more), medium (3) or
    high (5); reasons: their names, sorted. A null text has none.
    """
    t = F.coalesce(_c(text), F.lit(""))
    # letters that only case folding makes one of a pattern's
    bare = t
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        bare = F.replace(bare, F.lit(odd), F.lit(plain))

    def tried(low: Column) -> Column:
        has = lambda name: reduce(lambda a, b: a | b, (low.contains(x) for x in RISK_ANCHORS[name]))
        return F.array(*(F.when(has(name), t.rlike("(?iU)" + p)).otherwise(False) for name, p, _ in RISK_PATTERNS))

    def told(found: Column) -> Column:
        total = reduce(lambda a, b: a + b, (F.when(found[i], w).otherwise(0) for i, (_, _, w) in enumerate(RISK_PATTERNS)))
        level = lambda s: F.when(s >= 5, "high").when(s >= 3, "medium").when(s >= 1, "low").otherwise("none")
        names = F.array_compact(F.array(*(F.when(found[i], F.lit(name)) for i, (name, _, _) in enumerate(RISK_PATTERNS))))
        return F.struct(F.transform(F.array(total), level)[0].alias("level"), F.array_sort(names).alias("reasons"))

    # arrays of one hold what is used several times, so it is worked out once
    found = F.transform(F.array(F.lower(bare)), tried)
    return F.transform(found, told)[0]


def risk_reasons(text: str | Column) -> Column:
    """Sorted names of the risk patterns that the text matches."""
    return risk(text)["reasons"]


def risk_level(text: str | Column) -> Column:
    return risk(text)["level"]


def entropy(text: str | Column) -> Column:
    """Shannon entropy in bits a character."""
    letters = F.filter(F.split(_c(text), ""), lambda c: c != "")
    n = F.size(letters)
    shares = F.transform(F.array_distinct(letters), lambda k: F.size(F.filter(letters, lambda c: c == k)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def redact(text: str | Column, extra: Sequence[str] = ()) -> Column:
    """A struct (text, counts): credentials as ``[redacted:kind]``, and how many of each kind; kinds without any are left out.

    Named kinds go first, then long tokens of at least OPAQUE_BITS bits a
    character, then the ``extra`` patterns as ``custom``. Null stays null.
    """
    t = _c(text)
    counts: list[tuple[str, Column]] = []
    for name, pattern in CREDENTIAL_PATTERNS:
        counts.append((name, F.regexp_count(t, F.lit(pattern))))
        t = F.regexp_replace(t, pattern, f"[redacted:{name}]")
    opaque = lambda tokens: F.filter(tokens, lambda x: entropy(x) >= OPAQUE_BITS)
    tokens = F.regexp_extract_all(t, F.lit(f"({OPAQUE_TOKEN})"), 1)
    counts.append(("high_entropy_token", F.size(opaque(tokens))))
    gaps = F.split(t, OPAQUE_TOKEN, -1)
    shown = F.transform(tokens, lambda x: F.when(entropy(x) >= OPAQUE_BITS, "[redacted:high_entropy_token]").otherwise(x))
    woven = F.array_join(F.flatten(F.zip_with(gaps, shown, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")
    t = F.when(F.size(tokens) > 0, woven).otherwise(t)
    for pattern in extra:
        counts.append(("custom", F.regexp_count(t, F.lit(pattern))))
        t = F.regexp_replace(t, pattern, "[redacted:custom]")
    kinds = list(dict.fromkeys(k for k, _ in counts))
    entries = F.array(*(F.struct(F.lit(k).alias("k"), reduce(lambda a, b: a + b, (n for name, n in counts if name == k)).alias("n")) for k in kinds))
    return F.struct(t.alias("text"), F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0)).alias("counts"))


def claim_tokens(text: str | Column) -> Column:
    """The distinct lower-case ASCII words of two letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS)))


def support_share(claim: Column, evidence: Column) -> Column:
    """The share of the claim's tokens that the evidence has; 0 for a claim without tokens."""
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, evidence)) / F.size(claim)).otherwise(0.0)


def support_level(share: Column) -> Column:
    return F.when(share >= STRONG, "strong").when(share >= WEAK, "weak").otherwise("none")


def tag_enum(haystack: Column, rules: Mapping[str, Sequence[str]], fallback: str | None = None) -> Column:
    """The value whose patterns match most often, the first of equals; ``fallback`` if none matches."""
    scores = {v: reduce(lambda a, b: a + b, (F.regexp_count(haystack, F.lit("(?iU)" + p)) for p in ps)) for v, ps in rules.items() if ps}
    if not scores:
        return F.lit(fallback)
    best = F.greatest(F.lit(0), *scores.values())
    tag = F.lit(fallback).cast("string")
    for value in reversed(list(scores)):
        tag = F.when((best > 0) & (scores[value] == best), F.lit(value)).otherwise(tag)
    return tag


def reuse_multiplier(count: Column, weight: float) -> Column:
    """1 + weight * ln(1 + count), at most 1.5; 1 without uses or weight."""
    if weight <= 0:
        return F.lit(1.0)
    return F.when(F.coalesce(count, F.lit(0)) > 0, F.least(F.lit(1.5), 1 + F.lit(float(weight)) * F.log1p(count))).otherwise(1.0)


def resolve_score(raw: Column, certainty: Column, distance: Column) -> Column:
    return F.when(raw > 0, raw).when(certainty > 0, certainty).when(distance > 0, F.greatest(F.lit(0.0), 1 - distance / 2)).otherwise(0.0)


def certainty_of(cosine: Column) -> Column:
    return (1 + cosine) / 2


def is_stale(ingested_at: Column, kind: Column, now: Column, days: int = 90) -> Column:
    """Whether ingested more than ``days`` before ``now``; never for conversations and null times."""
    return F.coalesce((kind != "conversation") & (ingested_at < now - F.expr(f"INTERVAL {int(days)} DAYS")), F.lit(False))


def parse_timestamp(text: str | Column) -> Column:
    """ISO 8601, UTC where it names no zone; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(_c(text), "Z$", "+00:00"))


#: Characters of a snippet and of a recorded query, and snippets of a record.
SNIPPET_CHARS, QUERY_CHARS, SNIPPETS = 200, 2000, 5


def snippet(text: str | Column, n: int = SNIPPET_CHARS) -> Column:
    return F.substring(_c(text), 1, n)


def snippets(texts: str | Column) -> Column:
    """The first SNIPPETS texts of an array, each cut short; nulls among them are left out."""
    return F.transform(F.slice(F.array_compact(_c(texts)), 1, SNIPPETS), lambda t: snippet(t))


def recorded_query(text: str | Column) -> Column:
    return snippet(text, QUERY_CHARS)


def parse_pairs(told: str, low: float | None = None, high: float | None = None) -> dict[str, str | float]:
    """``k=v,k2=v2`` as a dict; numbers where bounds are given. Raises ValueError for bad pairs, repeated keys and values out of bounds."""
    found: dict[str, str | float] = {}
    for pair in filter(None, (p.strip() for p in told.split(","))):
        key, eq, value = (x.strip() for x in pair.partition("="))
        if not (key and eq and value) or key in found:
            raise ValueError(f"bad or repeated pair {pair!r}")
        found[key] = value if low is None else float(value)
        if low is not None and not low <= found[key] <= high:  # type: ignore[operator]
            raise ValueError(f"{pair!r} is out of bounds")
    return found


# Roles from least to most.
ROLES = ("viewer", "member", "admin", "owner")


def role_rank(role: str | Column) -> Column:
    """1 (viewer) to 4 (owner); null for what is no role."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(ROLES, 1):
        rank = F.when(_c(role) == name, i).otherwise(rank)
    return rank


# Verdicts on a page of results, why, and the retries that answer them.
SUFFICIENT, LOW, INSUFFICIENT = "sufficient", "low_confidence", "insufficient_evidence"
NO_RESULTS, LOW_TOP, FEW_RESULTS, FINE = "no_results", "top_score_below_threshold", "low_result_count", "ok"
KEYWORD_RETRY, BROADENED = "keyword_retry", "broadened_query"
#: The best score of a page that is no weak one, and its least number of results.
TOP_SCORE, MIN_RESULTS = 0.5, 2


def _gated(top: Column, n: Column, none: str, low: str, few: str, fine: str) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, none).when(top < TOP_SCORE, low).when(n < MIN_RESULTS, few).otherwise(fine)


def gate_verdict(top: Column, n: Column) -> Column:
    """What a page's best score and number of results say of it."""
    return _gated(top, n, INSUFFICIENT, LOW, INSUFFICIENT, SUFFICIENT)


def gate_reason(top: Column, n: Column) -> Column:
    return _gated(top, n, NO_RESULTS, LOW_TOP, FEW_RESULTS, FINE)


def strip_nul(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), "\\x00", "")


def normalise_page(text: str | Column) -> Column:
    """A page's text: words broken by a hyphen joined, runs of blanks as one, lines without trailing blanks."""
    t = F.regexp_replace(_c(text), r"([a-z])-\n([a-z])", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"(?m)[ \t]+$", "")


def is_unsafe_path(path: str | Column) -> Column:
    """Whether a path climbs, is absolute or names a drive."""
    return _c(path).rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")


def image_placeholder(name: str | Column) -> Column:
    return F.concat(F.lit("[image: "), _c(name), F.lit(", no text extracted]"))


def case_key(query: str | Column) -> Column:
    return F.md5(F.lower(_c(query)).cast("binary"))
