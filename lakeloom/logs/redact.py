"""Redaction: identifiers are replaced by a short hash, so equal ones stay recognisable."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field names whose values are hashed whole, in any case. Fixed values.
SENSITIVE = [
    "bucket", "object", "key", "prefix", "access_key", "accessKey", "host", "remote_addr", "remotehost", "endpoint", "peer", "ip",
    "path", "file_path", "disk", "drive", "volume", "volumes", "url", "node", "user", "username", "resource",
]

#: The same names in a message, with `=` or `:` and a value in quotes or up to a blank or a delimiter. Fixed pattern.
FIELD = r"""\b(bucket|object|key|prefix|access[_-]?key|host|remote_addr|remotehost|endpoint|peer|ip|path|file_path|disk|drive|volume|volumes|url|node|user|username|resource)(\s*[:=]\s*)("[^"]*"|'[^']*'|[^\s,;)\]}"']+)"""
#: Addresses. Fixed patterns.
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b"
IPV6 = r"\b(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:)+:[0-9a-f]{0,4}(?::[0-9a-f]{1,4})*|::(?:[0-9a-f]{1,4})(?::[0-9a-f]{1,4})*)\b"


def hashed(value: Column) -> Column:
    return F.concat(F.lit("h:"), F.substring(F.sha2(value, 256), 1, 16))


def redact_field(name: Column, value: Column) -> Column:
    return F.when(F.lower(name).isin(*{n.lower() for n in SENSITIVE}), hashed(value)).otherwise(redact_text()(value))


def redact_provenance(path: Column) -> Column:
    """What stands before the last `/` or `!` hashed, the rest kept."""
    leaf = F.regexp_extract(path, r"([/!][^/!]*)$", 1)
    return F.when(leaf == "", path).otherwise(F.concat(hashed(F.substr(path, F.lit(1), F.length(path) - F.length(leaf))), leaf))


def redact_text():
    """Identifiers behind their names, then IPv4 and IPv6 addresses. The replacement depends on the match, so this is a pandas function."""
    field, v4, v6 = re.compile(FIELD, re.I), re.compile(IPV4), re.compile(IPV6, re.I)

    def scrub(x: pd.Series) -> pd.Series:
        short = lambda s: "h:" + hashlib.sha256(s.encode()).hexdigest()[:16]

        def one(s):
            if s is None:
                return None
            s = field.sub(lambda m: m[1] + m[2] + short(m[3].strip("\"'")), s)
            return v6.sub(lambda m: short(m[0]), v4.sub(lambda m: short(m[0]), s))

        return x.map(one, na_action="ignore")

    return F.pandas_udf(scrub, "string")
