"""Redaction, path audit and position arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word boundary that treats accented letters as word characters.
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_START = rf"(?<!{_WORD})"
_END = rf"(?!{_WORD})"

# What counts as a secret, in the order it is removed.
BEARER = rf"(?i)Bearer(?<!{_WORD}Bearer)\s+[A-Za-z0-9\-._~+/]+=*"
BASIC = rf"(?i)Basic(?<!{_WORD}Basic)\s+[A-Za-z0-9\-._~+/]+=*"
URL_PASSWORD = r"([a-zA-Z][a-zA-Z0-9+.\-]*://)([^:/?\s@]+):([^/?\s]+)@"
KNOWN_SECRET = (
    rf"{_START}AKIA[0-9A-Z]{{16}}{_END}"
    rf"|{_START}(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{{10,}}{_END}"
    rf"|{_START}gh[aoprsu]_[A-Za-z0-9]{{20,}}{_END}"
    rf"|{_START}xox[baprs]-[A-Za-z0-9\-]{{10,}}{_END}"
)
CREDENTIAL_KEY = (
    r"(?i)(password|passwd|secret|api[_-]?key|token|access[_-]?key|credential)"
    r"(\s*[:=]\s*\"?)([^\s\"',}]+)"
)
# Token characters are ASCII, and so are the word boundaries around them: a run may
# start or end right beside an accented letter.
_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
GENERIC_TOKEN = rf"{_EDGE}[A-Za-z0-9\-_]{{20,}}{_EDGE}"
# User directories in paths, and names that belong to nobody.
HOME_PATH = r"[/\\](?:Users|home)[/\\]([A-Za-z0-9._-]*[A-Za-z0-9][A-Za-z0-9._-]*)"
SYNTHETIC_USERS = ("example", "exampleuser", "dev", "rhc", "runner", "runneradmin")

# What a text must contain for a pattern to be worth running, per pattern. The
# plain search is far cheaper than the expression and never rules out a match.
_HINTS = {
    "bearer": (True, ("bearer",)),
    "basic": (True, ("basic",)),
    "url_password": (False, ("://",)),
    "known_secret": (False, ("AKIA", "_live_", "_test_", "gh", "xox")),
    "credential_key": (True, ("passw", "secret", "key", "token", "credential")),
}

SECRET_PATTERNS = {
    "bearer": BEARER,
    "basic": BASIC,
    "url_password": URL_PASSWORD,
    "known_secret": KNOWN_SECRET,
    "credential_key": CREDENTIAL_KEY,
    "generic_token": GENERIC_TOKEN,
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _may_match(text: Column, pattern: str) -> Column:
    if pattern not in _HINTS:
        return F.lit(True)
    fold, hints = _HINTS[pattern]
    hay = F.lower(text) if fold else text
    out = hay.contains(hints[0])
    for h in hints[1:]:
        out = out | hay.contains(h)
    return out


def _replace(text: Column, source: Column, pattern: str, by: str) -> Column:
    # The hint is looked up in the original text: removing secrets adds none.
    return F.when(_may_match(source, pattern), F.regexp_replace(text, SECRET_PATTERNS[pattern], by)).otherwise(text)


def redact(text: Column | str, home: str | None = None) -> Column:
    """Secrets replaced by ``[REDACTED]``; the given home directory by ``~``."""
    source = _c(text)
    t = _replace(source, source, "bearer", "Bearer [REDACTED]")
    t = _replace(t, source, "basic", "Basic [REDACTED]")
    t = _replace(t, source, "url_password", "$1$2:[REDACTED]@")
    t = _replace(t, source, "known_secret", "[REDACTED]")
    t = _replace(t, source, "credential_key", "$1$2[REDACTED]")
    return F.replace(t, F.lit(home), F.lit("~")) if home else t


def redact_generic_tokens(text: Column | str) -> Column:
    """Any 20 or more token characters in a row; broad, so opt-in."""
    return F.regexp_replace(_c(text), GENERIC_TOKEN, "[REDACTED]")


def pattern_hits(text: Column | str) -> Column:
    """One struct per secret pattern with its number of matches."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("pattern"),
                F.when(_may_match(_c(text), name), F.regexp_count(_c(text), F.lit(p))).otherwise(0).cast("bigint").alias("hits"),
            )
            for name, p in SECRET_PATTERNS.items()
        ]
    )


def home_path_users(text: Column | str) -> Column:
    names = F.regexp_extract_all(_c(text), F.lit(HOME_PATH), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*SYNTHETIC_USERS))


def collapse_whitespace(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\s+", " ")


def utf16_length(text: Column | str) -> Column:
    """UTF-16 code units: supplementary characters count twice."""
    t = _c(text)
    return (F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("bigint")


def utf16_column(line: Column | str, byte_offset: Column | str) -> Column:
    """UTF-16 column of a byte offset (on a character edge) inside a line."""
    prefix = F.substr(F.encode(_c(line), "UTF-8"), F.lit(1), _c(byte_offset).cast("int"))
    return utf16_length(F.decode(prefix, "UTF-8"))


def blank(text: Column | str) -> Column:
    """Same UTF-16 length, only line breaks kept."""
    wide = F.regexp_replace(_c(text), r"[\x{10000}-\x{10FFFF}]", "  ")
    return F.regexp_replace(wide, r"[^\r\n]", " ")
