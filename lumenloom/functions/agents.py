"""User agents: device, browser and operating system; principals and load balancers by short names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of bots; browsers and systems in the order of the tests.
BOTS = r"(?i)bot|crawler|spider|scraper|curl|wget|python|java|go-http|axios|node-fetch|ELB-HealthChecker|Prometheus|sentry"
BROWSERS = [
    ("Chrome", r"(?i)Chrome/(\d+[\d.]*)"),
    ("Firefox", r"(?i)Firefox/(\d+[\d.]*)"),
    ("Safari", r"(?i)Safari/(\d+[\d.]*)"),
    ("Edge", r"(?i)Edge/(\d+[\d.]*)"),
    ("Internet Explorer", r"(?i)MSIE\s+(\d+[\d.]*)"),
    ("Opera", r"(?i)Opera/(\d+[\d.]*)"),
    ("Sentry SDK", r"(?i)sentry[.-]?(\S+)"),
    ("curl", r"(?i)curl/(\d+[\d.]*)"),
    ("Python Requests", r"(?i)python-requests/(\d+[\d.]*)"),
    ("Go HTTP Client", r"(?i)Go-http-client/(\d+[\d.]*)"),
    ("Axios", r"(?i)axios/(\d+[\d.]*)"),
]
#: Marks of systems in the order of the tests, and what stands before their version (empty: none is said).
SYSTEMS = [
    ("Windows", "Windows NT ", "Windows NT "),
    ("macOS", "Mac OS X ", "Mac OS X "),
    ("Linux", "Linux", ""),
    ("Android", "Android ", "Android "),
    ("iOS", "iPhone OS ", "iPhone OS "),
    ("iPadOS", "iPad", "OS "),
]
MAX_NAME = 32


def device(agent: Column) -> Column:
    low = F.lower(agent)
    return F.when(agent.rlike(BOTS), "bot").when(low.rlike("mobile|android|iphone"), "mobile").when(low.rlike("tablet|ipad"), "tablet").otherwise("desktop")


def _head(agent: Column) -> Column:
    """What stands before the first slash, where that is short enough for a name."""
    head = F.substring_index(agent, "/", 1)
    return F.when(F.length(head) < 50, head)


def _holds(low: Column, pattern: str) -> Column:
    """A quick test before a browser's pattern: the letters that it begins with."""
    mark = re.match(r"\(\?i\)([A-Za-z-]+)", pattern)[1].lower()
    return low.contains(mark)


def browser(agent: Column) -> Column:
    low, out = F.lower(agent), F.nullif(F.trim(_head(agent)), F.lit(""))
    for name, pattern in reversed(BROWSERS):
        out = F.when(_holds(low, pattern) & agent.rlike(pattern), name).otherwise(out)
    return out


def browser_version(agent: Column) -> Column:
    low, out = F.lower(agent), F.when(_head(agent).isNotNull(), F.nullif(F.regexp_extract(agent, r"^[^/]*/([^ ]*)", 1), F.lit("")))
    for _, pattern in reversed(BROWSERS):
        out = F.when(_holds(low, pattern) & agent.rlike(pattern), F.regexp_extract(agent, pattern, 1)).otherwise(out)
    return out


def _systems(agent: Column, then) -> Column:
    """then(name, what stands before the version) of the first system whose mark the agent has, a digit behind it where a version is said."""
    low, out = F.lower(agent), F.lit(None).cast("string")
    for name, mark, before in reversed(SYSTEMS):
        is_it = low.contains(mark.lower())
        if before:
            is_it = is_it & low.rlike(before.lower() + r"\d")
        out = F.when(is_it, then(name, before)).otherwise(out)
    return out


def system(agent: Column) -> Column:
    return _systems(agent, lambda name, _: F.lit(name))


def system_version(agent: Column) -> Column:
    """Digits behind the system's name, divided by dots."""
    version = lambda before: F.translate(F.nullif(F.regexp_extract(F.lower(agent), before.lower() + r"(\d+(?:[._]\d+)*)", 1), F.lit("")), "_", ".")
    return _systems(agent, lambda _, before: version(before) if before else F.lit(None).cast("string"))


#: How a principal's short name is cut from it: a prefix that goes, what stands for it, and whether only the last part of the rest stays.
PREFIXES = [("system:serviceaccount:", "", True), ("system:node:", "node-", False), ("system:", "", False)]
ENDINGS = [(".amazonaws.com", "AWS Internal")]


def short_principal(who: Column, rules: tuple[tuple[str, str], ...] = ()) -> Column:
    """A short service name for an account, role, user or mail address."""
    p = F.trim(who)
    last = lambda c, sep: F.substring_index(c, sep, -1)
    out = F.when(p.startswith("arn:"), last(last(p, ":"), "/")).when(F.call_function("instr", p, F.lit("@")) > 1, F.substring_index(p, "@", 1)).otherwise(p)
    for ending, short in ENDINGS:
        out = F.when(p.endswith(ending), short).otherwise(out)
    for prefix, front, last_only in reversed(PREFIXES):
        left = F.substr(p, F.lit(len(prefix) + 1))
        out = F.when(p.startswith(prefix), F.concat(F.lit(front), last(left, ":") if last_only else left)).otherwise(out)
    out = F.left(out, F.lit(MAX_NAME))
    for part, short in reversed((*rules, ("container-engine-robot", "gke-robot"))):
        out = F.when(p.contains(part), short).otherwise(out)
    return F.nullif(out, F.lit(""))


def alias(account: Column, aliases: dict[str, str]) -> Column:
    """An account's display name, or the account itself."""
    out = account
    for k, v in aliases.items():
        out = F.when(account == k, v).otherwise(out)
    return out


def backend_service(name: Column) -> Column:
    """A cluster's backend is named k8s, an id of eight digits, its service and another such id, with dashes between."""
    parts = F.split(name, "-")
    is_id = lambda c: (F.length(c) == 8) & c.rlike("^[0-9a-f]*$")
    n = F.size(parts)
    made = F.get(parts, F.lit(0)).rlike("^k8s[0-9]*$") & (n >= 4) & is_id(F.get(parts, F.lit(1))) & is_id(F.element_at(parts, -1))
    return F.when(made, F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 3, F.lit(0))), "-")).otherwise(name)


def load_balancer(resource_id: Column) -> Column:
    parts = F.split(resource_id, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(resource_id)
