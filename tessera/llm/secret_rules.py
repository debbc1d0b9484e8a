"""Kinds of secrets: a pattern each, and how long its match or one group of it must be."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    #: Shorter matches are dropped; what they cover isn't looked at again.
    least: int = 0


#: Fixed values, in the order in which kinds are listed.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
]

#: Formats that their issuers have published.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{40,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9_.~+/-]{20,}=*"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
]
