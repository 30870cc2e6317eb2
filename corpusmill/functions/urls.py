"""URLs taken apart, resolved and brought to one form, as column expressions.

The parts are those of RFC 3986: scheme, authority, path, query, fragment.  Two URLs that name the same page in all practice get the same form: scheme
and host in lower case, no user, default port, fragment or dot segments, percent codes only where they are needed and in upper case, query parameters
sorted and without those that only track visits.

Each function takes or gives a struct, so that a query can hold it in a column (``DataFrame.withColumn``) and Spark doesn't repeat the work for each use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?"
_AUTHORITY = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
_TOKEN = r"%[0-9A-Fa-f]{2}|(?s:.)"
# Parameters that only track visits, and the ports that schemes imply.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src|sessionid|phpsessid)(=|$)"
PORTS = {"http": "80", "https": "443"}


def parts(url: Column) -> Column:
    """A struct of an address's parts; the marks tell an empty authority or query from none."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    found = {"scheme": F.lower(part(1)), "has_authority": part(2) != "", "authority": part(3), "path": part(4), "has_query": part(5) != "", "query": part(6)}
    return F.struct(*(c.alias(n) for n, c in found.items()))


def resolved(base: Column, link: Column) -> Column:
    """The parts of a link seen from a base, by RFC 3986, 5.2.2 (dot segments are taken out later)."""
    own, host = link["scheme"] != "", link["has_authority"]
    full = own | host
    stays = ~full & (link["path"] == "")
    merged = F.when(base["has_authority"] & (base["path"] == ""), F.concat(F.lit("/"), link["path"])).otherwise(F.concat(F.regexp_replace(base["path"], "[^/]*$", ""), link["path"]))
    found = {
        "scheme": F.when(own, link["scheme"]).otherwise(base["scheme"]),
        "has_authority": F.when(full, host).otherwise(base["has_authority"]),
        "authority": F.when(full, link["authority"]).otherwise(base["authority"]),
        "path": F.when(full | link["path"].startswith("/"), link["path"]).when(stays, base["path"]).otherwise(merged),
        "has_query": F.when(stays & ~link["has_query"], base["has_query"]).otherwise(link["has_query"]),
        "query": F.when(stays & ~link["has_query"], base["query"]).otherwise(link["query"]),
    }
    return F.struct(*(c.alias(n) for n, c in found.items()))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, without ``.`` and ``..``."""
    pieces = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    last = F.element_at(pieces, -1)
    kept = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)),
    )
    ends = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def encoded(text: Column) -> Column:
    """Percent codes of unreserved characters undone, the others in upper case; characters that a URL can't hold encoded."""

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 2, 2), 16, 10).cast("int")
        plain = F.char(code)
        return (
            F.when((F.length(x) == 3) & plain.rlike(r"^[A-Za-z0-9._~\-]$"), plain)
            .when(F.length(x) == 3, F.upper(x))
            .when(x.rlike(r"^[A-Za-z0-9._~\-!$&'()*+,;=:@/?\[\]]$"), x)
            .when(x == " ", "%20")
            .otherwise(F.url_encode(x))
        )

    return F.when(text.rlike(r"^[A-Za-z0-9._~\-!$&'()*+,;=:@/?]*$"), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)), one), ""))


def host_of(p: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(p["authority"], _AUTHORITY, 1), r"\.+$", ""))


def normal(p: Column) -> Column:
    """A struct of scheme, host, port, path and query parameters, each in its one form."""
    params = F.array_sort(F.transform(F.filter(F.split(p["query"], "&", -1), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)), encoded))
    path = encoded(without_dots(F.when(p["path"] == "", "/").otherwise(p["path"])))
    return F.struct(p["scheme"].alias("scheme"), host_of(p).alias("host"), F.regexp_extract(p["authority"], _AUTHORITY, 2).alias("port"), path.alias("path"), params.alias("params"))


def address(n: Column) -> Column:
    """The one form of an address, from its ``normal`` parts; null for anything but http and https with a host."""
    usual = F.lit(False)
    for scheme, number in PORTS.items():
        usual = usual | ((n["scheme"] == scheme) & (n["port"] == number))
    port = F.when((n["port"] == "") | usual, "").otherwise(F.concat(F.lit(":"), n["port"]))
    query = F.when(F.size(n["params"]) > 0, F.concat(F.lit("?"), F.array_join(n["params"], "&"))).otherwise("")
    return F.when(n["scheme"].isin(*PORTS) & (n["host"] != ""), F.concat(n["scheme"], F.lit("://"), n["host"], port, n["path"], query))
