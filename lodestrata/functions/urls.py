"""Acceptance of repository URLs: an ordered list of rejections, the first that holds is the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one accepted host, the longest accepted URL and what a name may be made of.
HOST = "github.com"
LONGEST = 2048
NAME = "[A-Za-z0-9_.-]+"


def _place(url: Column) -> Column:
    """What stands between // and the path."""
    return F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)


def rejection(url: Column) -> Column:
    """Why a URL is rejected; null if it is accepted. Scheme and host may be in any case."""
    has = lambda pattern: F.rlike(url, F.lit(pattern))
    user = F.regexp_extract(_place(url), "^(.*)@", 1)
    host = F.regexp_replace(_place(url), "^.*@", "")
    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when(F.length(url) > LONGEST, "too_long")
        .when(F.contains(url, F.lit("%")), "percent")
        .when(has(r"(?U)[\x00-\x1f\x7f\s]"), "control_or_space")
        .when(F.startswith(url, F.lit("-")), "leading_dash")
        .when(~has("^(?i)https:"), "scheme")
        .when(~user.isin("", ":"), "credentials")
        .when(F.lower(F.regexp_extract(host, "^([^:]*)", 1)) != HOST, "host")
        .when(F.rlike(host, F.lit(":.")), "port")
        .when(has(r"^[^#?]*\?[^#]"), "query")
        .when(has("#."), "fragment")
        .when(~has(f"^(?i)https://{HOST}/{NAME}/{NAME}/?$"), "path")
        .when(~has(f"^(?i)https://{HOST}/[a-z0-9]"), "owner")
        .when(~has(f"^(?i)https://{HOST}/{NAME}/[a-z0-9]"), "repository")
    )


def normal_url(url: Column) -> Column:
    """An accepted URL in its one form: owner and repository as written, without closing slash and ``.git``."""
    parts = rf"^(?i)https://{HOST}/({NAME})/({NAME}?)(\.git)?/?$"
    return F.concat(F.lit(f"https://{HOST}/"), F.regexp_extract(url, parts, 1), F.lit("/"), F.regexp_extract(url, parts, 2))


def is_sha(value: Column) -> Column:
    return F.rlike(value, F.lit("^[0-9a-fA-F]{7,40}$"))
