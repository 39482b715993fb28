"""Scalar functions on log text. All take and give Columns, so that Catalyst sees plain expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of headers, identifiers and placeholders.
HEADER = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+([A-Z]+)\s+([^:]+):\s?(.*)$"
BLOCK_ID = r"(?U)\bblk_-?\d+\b"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
ENDPOINT = rf"(?U)(\b(?:src|dest):[ \t]*/)({_IPV4})(:[0-9]+)(?![\w.:])"
IPV4_PORT = rf"(?U)(?<![\w.])(/?)({_IPV4})(:[0-9]+)(?![\w.])"
IPV4_BARE = rf"(?U)(?<![\w.:])(/?)({_IPV4})(?![\w.:])"
JOB_ID = r"(?<![A-Za-z0-9_.-])job_[0-9]{12}_[0-9]{4}(?![A-Za-z0-9_.-])"
PATH = r"(?U)(?<!\S)/(?:[A-Za-z0-9._<>-]+/)+[A-Za-z0-9._<>-]+(?!\S)"
UUID = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"
TIMESTAMP = r"(?U)\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
URL = r"(?U)https?://[^\s,)]+"
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
IP = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
HEX = r"(?U)\b[A-Fa-f0-9]{16,}\b"
NUMBER = r"(?U)(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?![A-Za-z])"
KEY_VALUE = r"(?U)(\b(?:id|Id|ID|token|correlationId|tenant|empresa|port|size|count)=)[^\s,;)]+"
JWT = r"(?U)\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
TOKEN = r"<(?:BLOCK_ID|JOB_ID|IP|PATH|\*)>|[A-Za-z0-9_]+(?:[.$:-][A-Za-z0-9_]+)*\*?"
TERMS = {"has_exception_term": "exception", "has_failed_term": "failed", "has_timeout_term": "timeout", "has_error_term": "error"}
CALL_STACK = r"\):([A-Za-z0-9_-]+)/"
SCHEDULER = r"(?iu)(?:scheduler\s+recusou|recusou\s+\d+\s+de\s+\d+\s+task|task[^\n]{0,120}(?:órfã|orf[aã]|em\s+execução|em\s+execucao))"
EXPLICIT = (r"(?iU)\bserviceStarted\s*[:=]\s*([A-Za-z0-9_.-]+)", r"(?iuU)\b(?:serviço|service)\s+(?:responsável|responsible|target|alvo)\s*[:=]?\s*([A-Za-z0-9_.-]+)")
TARGET = r"(?i)service:\s*([A-Za-z0-9_-]+)"
CLOCK = r"(?U)\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b"
SIGNAL_WORD = r"(?iuU)\b(ERROR|WARN|Exception|timeout|failed|recusou|órfã|orf[aã])\b"
RATIONALE = r"(?iuU)\b(causa|nasce|propaga|devido|porque|consistente|precedido|origem|responsável|responsavel|falha)\b"
LOGICAL_COMPONENTS = ("catalog", "scheduler", "security")


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return strip(c) == ""


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def sub_each(c: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """c with every match of pattern replaced by make(match). c is bound to a variable, so nested calls evaluate it once each."""

    def each(x: Column) -> Column:
        parts = F.zip_with(F.split(x, pattern, -1), F.concat(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), make), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(x.rlike(pattern), F.array_join(parts, "")).otherwise(x)

    return F.element_at(F.transform(F.array(c), each), 1)


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def parse_log_line(line: Column) -> Column:
    """Struct (date, time, pid, level, component, content) of a header line, else null."""
    part = lambda i: F.regexp_extract(line, HEADER, i)
    return F.when(line.rlike(HEADER), F.struct(part(1).alias("date"), part(2).alias("time"), part(3).cast("int").alias("pid"), part(4).alias("level"), strip(part(5)).alias("component"), part(6).alias("content")))


def iso_timestamp(date: Column, time: Column) -> Column:
    """yyMMdd and HHmmss as ISO text; two-digit years 69 to 99 are of the last century. Null if that is no time."""
    year = F.substring(date, 1, 2).cast("int")
    full = F.concat(F.when(year >= 69, "19").otherwise("20"), date, time)
    return F.date_format(F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss")


def block_mentions(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(BLOCK_ID), F.lit(0))


def block_ids(content: Column) -> Column:
    """Distinct ids in order of first mention."""
    return F.array_distinct(block_mentions(content))


def mask_a(c: Column) -> Column:
    """Block ids, and the addresses of src and dest endpoints."""
    return _chain(c, (BLOCK_ID, "<BLOCK_ID>"), (ENDPOINT, "$1<IP>$3"))


def mask_b(c: Column) -> Column:
    """Block ids, and every valid address that has a port."""
    return _chain(c, (BLOCK_ID, "<BLOCK_ID>"), (IPV4_PORT, "$1<IP>$3"))


def mask_c(c: Column) -> Column:
    return _chain(mask_b(c), (JOB_ID, "<JOB_ID>"))


def mask_d(c: Column) -> Column:
    """mask_c, then bare addresses, then absolute paths of two or more parts."""
    return _chain(mask_c(c), (IPV4_BARE, "$1<IP>"), (PATH, "<PATH>"))


MASKS = {"A": mask_a, "B": mask_b, "C": mask_c, "D": mask_d}


def prepare_message(c: Column, variant: str = "full") -> Column:
    """Text for template mining. Variants: full and temporal mask all kinds; current masks UUIDs and numbers only; aggressive also masks the values of some keys."""
    steps = [(UUID, "<UUID>")]
    if variant != "current":
        steps += [(TIMESTAMP, "<TIMESTAMP>"), (URL, "<URL>"), (EMAIL, "<EMAIL>"), (IP, "<IP>"), (HEX, "<HEX>")]
    steps.append((NUMBER, "<NUM>"))
    if variant == "aggressive":
        steps.append((KEY_VALUE, "$1<VALUE>"))
    return _chain(collapse(c), *steps)


def stable_token(prefix: str, value: Column, salt: str) -> Column:
    return F.concat(F.lit(f"<{prefix}_"), F.left(F.sha2(F.concat(F.lit(f"{salt}\0{prefix}\0"), value), 256), F.lit(20)), F.lit(">"))


def _token_maker(prefix: str, salt: str) -> Callable[[Column], Column]:
    return lambda match: stable_token(prefix, match, salt)


def anonymize_text(c: Column, salt: str) -> Column:
    """JWTs, e-mail addresses, IP addresses and long hex strings as stable tokens, one kind after another."""
    for prefix, pattern in (("JWT", JWT), ("EMAIL", EMAIL), ("IP", IP), ("HEX", HEX)):
        c = sub_each(c, pattern, _token_maker(prefix, salt))
    return c


def stable_digest(value: Column, salt: str) -> Column:
    """sha256(salt NUL value) in hex. An empty salt is refused at once, an empty value when it is met."""
    if not salt:
        raise ValueError("salt is empty")
    return F.when(F.coalesce(value, F.lit("")) == "", F.raise_error(F.lit("value is empty")).cast("string")).otherwise(F.sha2(F.concat(F.lit(f"{salt}\0"), value), 256))


def hash_text(c: Column) -> Column:
    return F.sha2(c, 256)


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def analyze_document(c: Column) -> Column:
    """Each line's tokens, then its pairs of neighbours; pairs never cross lines and repeats stay."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]")

    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(t, F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws(" ", a, b)))

    return F.flatten(F.transform(F.transform(lines, tokenize), both))


def normalize_message(c: Column) -> Column:
    """Short pattern of a message: UUIDs, quoted parts and numbers masked, white space collapsed, 80 characters."""
    masked = _chain(F.coalesce(c, F.lit("")), (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"), ("'[^']*'", "'…'"), (r"(?U)\d+", "N"))
    return F.left(collapse(masked), F.lit(80))


def short_logger(c: Column) -> Column:
    return F.substring_index(F.coalesce(c, F.lit("")), ".", -1)


def exception_head(stack: Column) -> Column:
    return F.left(collapse(F.element_at(F.split(strip(stack), r"\r\n|[\n\r\x0B\f]"), 1)), F.lit(200))


def parse_ts(c: Column) -> Column:
    """Timestamp of ISO text, fractions cut to microseconds, Z and offsets understood; null if it is none."""
    cutoff = F.regexp_replace(strip(c), r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(F.nullif(cutoff, F.lit("")))


def has_term(c: Column, term: str) -> Column:
    return c.rlike(rf"(?iU)\b{term}\b")


def any_term(c: Column) -> Column:
    return c.rlike(r"(?iU)\b(exception|failed|timeout|error)\b")


def level(c: Column) -> Column:
    return F.upper(strip(c))


def level_bucket(c: Column) -> Column:
    return F.when(level(c).isin("INFO", "WARN", "ERROR"), F.lower(level(c))).otherwise("other")


def trace_id(first: Column, second: Column) -> Column:
    """The first id that isn't blank, else null."""
    return F.coalesce(F.nullif(strip(first), F.lit("")), F.nullif(strip(second), F.lit("")))


def trace_id_source(first: Column, second: Column, names: tuple[str, str] = ("tc_trace_id", "traceId")) -> Column:
    return F.when(~blank(first), names[0]).when(~blank(second), names[1]).otherwise("none")


def call_stack_services(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CALL_STACK), F.lit(1)))


def call_stack_hits(c: Column, service: Column) -> Column:
    c, part = F.coalesce(c, F.lit("")), F.concat(F.lit("):"), service, F.lit("/"))
    return ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("int")


def explicit_component(message: Column) -> Column:
    """The component that a message names as the cause, else an empty string."""
    found = [F.regexp_extract(message, p, 1) for p in EXPLICIT]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def target_services(text: Column) -> Column:
    """Distinct services named as `service: x`, ordered without regard to case."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TARGET), F.lit(1)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def names_scheduler(text: Column) -> Column:
    return text.rlike(SCHEDULER)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def signal_profile(error: Column, warn: Column, stack: Column, text: Column) -> Column:
    parts = F.concat_ws("+", F.when(error, "ERROR"), F.when(warn, "WARN"), F.when(stack, "STACK_TRACE"), F.when(text, "TEXT"))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("NONE"))


def encode_counts(counts: Column) -> Column:
    """Map id -> count as "id:count id:count", ids ascending."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")


def decode_counts(text: Column) -> Column:
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda x: x != "")
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("key"), F.split(x, ":")[1].cast("long").alias("value"))))


def encode_sequence(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def decode_sequence(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda x: x != ""), lambda x: x.cast("int"))


def justification_score(service: Column, evidence: Column) -> Column:
    """0 to 5: evidence there, service named in it, a clock time, a signal word, a word of reasoning."""
    service, evidence = strip(service), strip(evidence)
    named = (service != "") & (F.lower(service) != "nenhum") & F.contains(F.lower(evidence), F.lower(service))
    checks = [evidence != "", named, evidence.rlike(CLOCK), evidence.rlike(SIGNAL_WORD), evidence.rlike(RATIONALE)]
    return sum((x.cast("int") for x in checks[1:]), checks[0].cast("int"))


def completeness(*columns: Column) -> Column:
    first, *rest = [(~blank(c)).cast("int") for c in columns]
    return sum(rest, first)


def clean_float(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def canonical_name(name: Column, vocabulary: Column, logical: tuple[str, ...] = LOGICAL_COMPONENTS) -> Column:
    """name in lower case if it is in the vocabulary (an array) or a logical component, else the one entry it ends in after a dash, else null."""
    name = F.lower(strip(name))
    ends = F.filter(vocabulary, lambda v: F.endswith(name, F.concat(F.lit("-"), v)))
    return F.when(F.array_contains(vocabulary, name) | name.isin(*logical), name).when(F.size(ends) == 1, F.element_at(ends, 1))
