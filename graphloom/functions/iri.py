"""RFC 3986 percent-encoding and validation as group-free regular expressions.

Valid escapes are replaced by one character first, so that the patterns are plain
character classes: a group repeated per character overflows the stack on long values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_P = "A-Za-z0-9._~!$&'()*+,;=:@-"
_N = "A-Za-z0-9._~!$&'()*+,;=@-"
_AUTHORITY = r"(?:[A-Za-z0-9._~!$&'()*+,;=:-]*@)?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._~!$&'()*+,;=-]*)(?::[0-9]*)?"
_TAIL = rf"(?:\?[/?{_P}]*)?(?:#[/?{_P}]*)?"
_ABSOLUTE_BODY = rf"[A-Za-z][A-Za-z0-9+.-]*:(?://{_AUTHORITY}(?:/[/{_P}]*)?|/(?:[{_P}][/{_P}]*)?|[{_P}][/{_P}]*|){_TAIL}"
_RELATIVE_BODY = rf"(?://{_AUTHORITY}(?:/[/{_P}]*)?|/(?:[{_P}][/{_P}]*)?|[{_N}]+(?:/[/{_P}]*)?|){_TAIL}"
ABSOLUTE = rf"^{_ABSOLUTE_BODY}\z"
REFERENCE = rf"^(?:{_ABSOLUTE_BODY}|{_RELATIVE_BODY})\z"
ESCAPE = "%[0-9A-Fa-f]{2}"
INVALID = "INVALID"

#: What a percent-encoded value can look like, at either extreme.
_SAMPLES = ("", "x", "1", "-", "%20", "~.%C3%A9")


def uri_encode(value: Column) -> Column:
    """Everything outside the unreserved characters as percent-escapes of its UTF-8 bytes."""
    out = F.url_encode(value)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, ESCAPE, "_")


def resolve(value: Column, base: str | None, on_invalid: str) -> Column:
    """An absolute IRI as it is, else ``base`` put before it; ``on_invalid``: keep (the text INVALID), drop (null) or fail."""
    joined = F.concat(F.lit(base), value) if base else value
    if on_invalid == "keep":
        bad: Column = F.lit(INVALID)
    elif on_invalid == "drop":
        bad = F.lit(None).cast("string")
    else:
        bad = F.raise_error(F.concat(F.lit("invalid IRI: "), joined)).cast("string")
    checked = F.when(_plain(value).rlike(ABSOLUTE), value).when(_plain(joined).rlike(REFERENCE), joined).otherwise(bad)
    return F.when(value.isNotNull(), checked)


def always_absolute(fixed: list[str | None]) -> bool:
    """Whether text with encoded values in the gaps (None) is an absolute IRI whatever the values are."""
    pattern = re.compile(ABSOLUTE.replace(r"\z", r"\Z"))
    return all(pattern.match(re.sub(ESCAPE, "_", "".join(s if t is None else t for t in fixed))) for s in _SAMPLES)
