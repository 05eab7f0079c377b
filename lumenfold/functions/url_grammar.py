"""Urls by the grammar of a strict parser, in stages of column expressions: authority, user, host, port, path, query.

What the parser accepts is written anew: the scheme in lower case, no fragment,
and parts with a character that must not stand there as itself are escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALNUM = r"A-Za-z0-9\-_.~"
# Characters that stand for themselves in a part of a url.
USER, HOST, PATH = rf"[{_ALNUM}$&+,;=]", rf"[{_ALNUM}!$&'()*+,;=:\[\]<>\"]", rf"[{_ALNUM}$&+,/:;=@]"
_USER_INFO = rf"^[{_ALNUM}:!$&'()*+,;=%@]*$"
_AS_WRITTEN = rf"^[{_ALNUM}$&+,/:;=@!'()*\[\]%]*$"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_NOT_IN_HOST = r"[\x00-\x20\\^`{|}/?@#\x7f]"
#: In a host only a percent sign itself and what is not ASCII may be escaped; a zone within brackets is freer.
_ASCII_ESCAPE = r"%(?!25)[0-7][0-9A-Fa-f]"


def _escaped(part: Column, plain: str) -> Column:
    """Escapes taken back, and everything but ``plain`` characters escaped again, byte by byte."""
    tokens = F.regexp_extract_all(part, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))

    def written(token: Column) -> Column:
        byte = F.conv(F.substring(token, 2, 2), 16, 10).cast("int")
        sign = F.when((F.length(token) == 3) & (byte < 128), F.char(byte)).when(F.length(token) < 3, token)
        code = F.when(F.length(token) == 3, F.upper(token)).otherwise(F.regexp_replace(F.hex(F.encode(token, "UTF-8")), "(..)", "%$1"))
        return F.when(sign.rlike(rf"^{plain}$"), sign).otherwise(code)

    return F.when(part.rlike(rf"^{plain}*$"), part).otherwise(F.array_join(F.transform(tokens, written), ""))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values, each worked out once: an expression used in many places would be copied to all of them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _group(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def parsed_url(raw: Column) -> Column:
    """struct(url, domain, error) of a trimmed url; the error says why an http(s) url with a host can't be made of it."""

    def fragment(x: Column) -> Column:
        raw = x["raw"]
        return _let({"raw": raw, "main": F.substring_index(raw, "#", 1), "fragment": _group(raw, r"(?s)^[^#]*#(.*)$")}, scheme)

    def scheme(x: Column) -> Column:
        main = x["main"]
        named = F.lower(_group(main, r"^([A-Za-z][A-Za-z0-9+.\-]*):"))
        rest = F.when(named != "", _group(main, r"(?s)^[^:]*:(.*)$")).otherwise(main)
        return _let({"all": x, "scheme": named, "before": F.substring_index(rest, "?", 1), "query": _group(rest, r"(?s)^[^?]*(\?.*)$")}, authority)

    def authority(x: Column) -> Column:
        before = x["before"]
        there = before.startswith("//") & ((x["scheme"] != "") | ~before.startswith("///"))
        found = F.when(there, _group(before, r"(?s)^//([^/]*)")).otherwise("")
        path = F.when(there, _group(before, r"(?s)^//[^/]*(.*)$")).otherwise(before)
        return _let({"all": x, "authority": found, "path": path, "opaque": (x["scheme"] != "") & ~before.startswith("/")}, user)

    def user(x: Column) -> Column:
        whole, named = x["authority"], x["authority"].contains("@")
        place = F.when(named, _group(whole, r"(?s)@([^@]*)$")).otherwise(whole)
        return _let({"all": x, "named": named, "user": _group(whole, r"(?s)^(.*)@"), "place": place, "name": _name(place)}, verdict)

    def verdict(x: Column) -> Column:
        parts, text = x["all"]["all"], x["all"]["all"]["all"]
        main, before, path, opaque = text["main"], parts["before"], x["all"]["path"], x["all"]["opaque"]
        bad_user = x["named"] & (~x["user"].rlike(_USER_INFO) | x["user"].rlike(_BAD_ESCAPE))
        no_scheme = (parts["scheme"] == "") & (main.startswith(":") | (~before.startswith("/") & F.substring_index(before, "/", 1).contains(":")))
        malformed = no_scheme | _bad_host(x["place"]) | bad_user | (~opaque & path.rlike(_BAD_ESCAPE)) | text["fragment"].rlike(_BAD_ESCAPE)
        error = (
            F.when(text["raw"].isNull() | (text["raw"] == ""), "url is empty")
            .when(main.rlike(r"[\x00-\x1f\x7f]"), "url has control characters")
            .when(malformed, "url is malformed")
            .when(~parts["scheme"].isin("http", "https"), "url scheme is not supported")
            .when(opaque | (x["name"] == ""), "url host is missing")
        )
        return _let({"all": x, "error": error}, result)

    def result(x: Column) -> Column:
        own, parts, path = x["all"], x["all"]["all"]["all"], x["all"]["all"]["path"]
        second = _group(own["user"], r"(?s)^[^:]*(:.*)$")
        secret = F.when(second != "", F.concat(F.lit(":"), _escaped(F.substring(second, 2, 1 << 30), USER))).otherwise("")
        known = F.when(own["named"], F.concat(_escaped(F.substring_index(own["user"], ":", 1), USER), secret, F.lit("@"))).otherwise("")
        clean = F.concat(
            parts["scheme"], F.lit("://"), known, _escaped(own["place"], HOST), F.when(path.rlike(_AS_WRITTEN), path).otherwise(_escaped(path, PATH)), parts["query"],
        )
        host = F.lower(F.try_url_decode(F.replace(own["name"], F.lit("+"), F.lit("%2B"))))
        good = x["error"].isNull()
        return F.struct(F.when(good, clean).alias("url"), F.when(good, host).alias("domain"), x["error"].alias("error"))

    return _let({"raw": raw}, fragment)


def _name(place: Column) -> Column:
    """The host without its port and brackets."""
    return F.regexp_replace(F.regexp_replace(place, r":[0-9]*$", ""), r"^\[(.*)\]$", "$1")


def _bad_host(place: Column) -> Column:
    bracket = place.startswith("[")
    port = F.when(bracket, ~place.rlike(r"(?s)^.*\](?::[0-9]*)?$")).otherwise(place.contains(":") & ~place.rlike(r":[0-9]*$"))
    outside = F.concat(F.substring_index(place, "%25", 1), _group(place, r"(\][^\]]*)$"))
    strict = F.when(bracket & place.contains("%25"), outside).otherwise(place)
    return port | place.rlike(_NOT_IN_HOST) | place.rlike(_BAD_ESCAPE) | strict.rlike(_ASCII_ESCAPE)
