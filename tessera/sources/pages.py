"""Pages instead of live fetching: which addresses may be opened, what their text is, and at what pace."""

from __future__ import annotations

import html
import ipaddress
import re
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of pages that are taken apart at a time.
GROUP = 1 << 20
#: Ports that may be opened.
PORTS = (80, 443, 8080, 8443)
#: Networks that may not be reached.
DENIED = tuple(map(ipaddress.ip_network, ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/128", "::1/128", "fe80::/10", "fec0::/10", "fc00::/7", "ff00::/8", "2001:db8::/32")))
NAT64, SIX_TO_FOUR = ipaddress.ip_network("64:ff9b::/32"), ipaddress.ip_network("2002::/16")
#: Content types that are read.
TYPES = ("text/html", "application/xhtml+xml", "text/plain", "")


def ip_denied(text: str) -> bool:
    """Whether an address lies in a denied network, also one embedded in a mapped, NAT64 or 6to4 address."""
    ip = ipaddress.ip_address(text)
    if any(ip.version == n.version and ip in n for n in DENIED):
        return True
    if ip.version == 6:
        inner = ip.ipv4_mapped
        if inner is None and ip in NAT64:
            inner = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
        if inner is None and ip in SIX_TO_FOUR:
            inner = ip.sixtofour
        return inner is not None and ip_denied(str(inner))
    return False


def check_url(url: str | None, onion: bool = False) -> str | None:
    """Why an address may not be opened; null if it may."""
    try:
        u = urlsplit(url or "")
        port, host = u.port, u.hostname
    except ValueError:
        return "invalid"
    if u.scheme not in ("http", "https"):
        return "scheme" if u.scheme else "invalid"
    if not host:
        return "invalid"
    return destination_denied(host, port or {"http": 80, "https": 443}[u.scheme], onion)


def destination_denied(host: str, port: int, onion: bool = False) -> str | None:
    if host.endswith(".onion") and not onion:
        return "onion"
    if port not in PORTS:
        return "port"
    try:
        return "address" if ip_denied(host.strip("[]")) else None
    except ValueError:
        return None


def denial(url: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(check_url), T.StringType())(url)


def readable(status: Column, kind: Column) -> Column:
    """Answers that are read: success, and text of a known type."""
    return status.between(200, 299) & F.lower(F.trim(F.split_part(F.coalesce(kind, F.lit("")), F.lit(";"), F.lit(1)))).isin(*TYPES)


_SKIP = re.compile(r"<(script|style|nav|aside|footer|header|form|noscript)\b.*?</\1\s*>|<!--.*?-->|<div[^>]*class=[\"']?(?:ad|ads|banner|menu|sidebar)\b.*?</div>", re.S | re.I)
_BLOCK = re.compile(r"<(?:p|div|li|h[1-6]|tr|br|article|section)\b[^>]*>|</(?:p|div|li|h[1-6]|tr|article|section)>", re.I)
_TAG = re.compile(r"<[^>]*>")


def extract(page: str | None) -> tuple[str | None, str]:
    """Title and main text of a page: scripts, styles, navigation and advertising go; the longest run of text-rich blocks stays."""
    page = page or ""
    m = re.search(r"<title[^>]*>(.*?)</title>", page, re.S | re.I)
    title = html.unescape(_TAG.sub("", m[1])).strip() or None if m else None
    body = re.search(r"<article\b[^>]*>(.*)</article>", page, re.S | re.I) or re.search(r"<body\b[^>]*>(.*)</body>", page, re.S | re.I)
    blocks = [html.unescape(_TAG.sub("", b)) for b in _BLOCK.split(_SKIP.sub(" ", body[1] if body else page))]
    return title, "\n".join(t for b in blocks if (t := " ".join(b.split())))


def extract_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """Adds ``title`` and ``text``. Few pages stand in a worker's memory at a time, however many a batch brings: about ``GROUP`` bytes, or one page."""
    kept = [c for c in pages.columns if c not in ("title", "text")]
    row = T.StructType([*(pages.schema[c] for c in kept), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(page)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, "right")))
                part = batch.slice(at, upto - at)
                got = [extract(x) for x in part.column(page).to_pylist()]
                made = [pa.array([g[i] for g in got], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, "title", "text"])
                at = upto

    return pages.mapInArrow(run, row)


def robots_allow(robots: str | None, status: int | None, agent: str, url: str) -> bool:
    """No rules (4xx) allow, failing servers (5xx, no answer) deny, unreadable rules allow."""
    if status is None or status >= 500:
        return False
    if status >= 400 or not robots:
        return True
    p = RobotFileParser()
    p.parse(robots.splitlines())
    return p.can_fetch(agent, url)


def politeness(fetches: DataFrame, host: str, ts: str, every: float = 2.0, burst: int = 2) -> DataFrame:
    """Fetches that came too soon: more than ``burst`` of a host within ``every`` seconds times the burst."""
    w = Window.partitionBy(host).orderBy(ts)
    return fetches.withColumn("too_soon", F.coalesce(F.col(ts).cast("double") - F.lag(ts, burst).over(w).cast("double") < every, F.lit(False)))
