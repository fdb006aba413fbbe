"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels.
MULTI_SUFFIXES = ("com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "com.hk", "com.tw", "com.sg", "co.jp", "co.uk", "com.au")
#: Those of the plain key, and the characters that stand for a url without a key there.
PLAIN_SUFFIXES, PLAIN_CHARS = ("com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn"), 60
#: Top domains that count as suspicious.
SUSPICIOUS_TLDS = ("xyz", "top", "info", "su", "ru", "cc", "tk", "ml", "ga", "cf", "gq", "biz", "click", "link", "loan")
#: What each url feature adds to the risk.
FEATURE_WEIGHTS = {
    "punycode_host": 0.20,
    "idn_non_ascii": 0.10,
    "suspicious_tld": 0.12,
    "subdomain_depth": 0.08,
    "hyphen_ratio": 0.06,
    "nonstd_port": 0.05,
    "ip_host": 0.15,
    "long_obfuscated_path": 0.05,
    "high_entropy_query": 0.10,
    "plain_http": 0.04,
    "deceptive_prefix": 0.15,
}

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _PARTS, k)


def port_text(url: Column) -> Column:
    return _part(url, 3)


def host(url: Column) -> Column:
    """Lower-case host without user, port, brackets or trailing dots; empty if unparseable."""
    name = F.rtrim(F.lower(F.regexp_replace(_part(url, 2), r"[\[\]]", "")), F.lit("."))
    port = port_text(url)
    sound = (port == "") | (port.rlike(r"^\d{1,5}$") & (port.try_cast("int") <= 65535))
    return F.when(F.coalesce(sound, F.lit(False)), name).otherwise("")


def path(url: Column) -> Column:
    return _part(url, 4)


def is_ip(name: Column) -> Column:
    return name.rlike(_IPV4) | name.contains(":")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def canonical_key(url: Column) -> Column:
    """The registrable domain; hosts of one label and addresses stay; empty if unparseable.

    Only the last two labels decide, so there is no loop.  Addresses of version 6
    are compressed, so all their forms share a key.
    """
    return _bound(host(url), key_of_host)


def compressed(name: Column) -> Column:
    """An address of version 6 in its shortest form; what is none stays as it is.

    ``::`` stands for as many zero groups as are missing; then the first of the
    longest runs of two or more zero groups becomes ``::``, and leading zeros go.
    """
    # a dotted end is two groups
    tail = r"^(.*:)(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)$"
    byte = lambda k: F.coalesce(F.regexp_extract(name, tail, k).try_cast("int"), F.lit(0))
    pair = lambda a, b: F.lower(F.hex(byte(a) * 256 + byte(b)))
    plain = F.when(name.rlike(tail), F.concat(F.regexp_extract(name, tail, 1), pair(2, 3), F.lit(":"), pair(4, 5))).otherwise(name)

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def filled(x: Column) -> Column:
        left, right = groups(x[0]), groups(F.coalesce(F.get(x, 1), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        whole = F.when(F.size(x) == 1, left).when((F.size(x) == 2) & (missing >= 1), F.concat(left, F.array_repeat(F.lit("0"), missing), right))
        sound = (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(sound, F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    def short(g: Column) -> Column:
        marks = F.array_join(F.transform(g, lambda x: F.when(x == "0", "z").otherwise("x")), "")
        cut = lambda at, n: F.concat(F.array_join(F.slice(g, F.lit(1), at - 1), ":"), F.lit("::"), F.array_join(F.slice(g, at + n, F.lit(8)), ":"))
        runs = [F.when(F.instr(marks, "z" * n) > 0, cut(F.instr(marks, "z" * n), n)) for n in range(8, 1, -1)]
        return F.coalesce(*runs, F.array_join(g, ":"))

    return _bound(F.split(plain, "::"), lambda x: _bound(filled(x), lambda g: F.coalesce(F.when(g.isNotNull(), short(g)), name)))


def key_of_host(name: Column) -> Column:
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last2 = F.concat_ws(".", F.slice(labels, -2, 2))
    tail = lambda k: F.concat_ws(".", F.slice(labels, -k, k))
    return (
        F.when(name.contains(":"), compressed(name))
        .when((n == 1) | is_ip(name) | name.rlike(r"(^|\.)(\.|$)"), name)
        .when((n >= 3) & last2.isin(*MULTI_SUFFIXES), tail(3))
        .when(F.element_at(labels, -1).rlike(r"^[a-z]{2,}$"), tail(2))
        .otherwise(name)
    )


def canonical_name(url: Column) -> Column:
    """The key, or the first 80 characters of the url."""
    return F.coalesce(F.nullif(canonical_key(url), F.lit("")), F.left(url, F.lit(80)))


def plain_key(url: Column) -> Column:
    """The key that case groups fall back to: fewer suffixes, and any last label counts as a top domain."""

    def key(name: Column) -> Column:
        labels = F.split(name, r"\.")
        long = (F.size(labels) >= 3) & F.concat_ws(".", F.slice(labels, -2, 2)).isin(*PLAIN_SUFFIXES)
        return F.when(is_ip(name) | (F.size(labels) < 2), name).when(long, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(F.concat_ws(".", F.slice(labels, -2, 2)))

    return _bound(host(url), key)


def plain_name(url: Column) -> Column:
    """The plain key, or the first characters of the url."""
    return F.coalesce(F.nullif(plain_key(url), F.lit("")), F.left(F.trim(F.coalesce(url, F.lit(""))), F.lit(PLAIN_CHARS)))


def same_site(a: Column, b: Column) -> Column:
    return (canonical_key(a) == canonical_key(b)) & (canonical_key(a) != "")


def alias_label(url: Column) -> Column:
    """How a url differs from its key: www, subdomain, port, path."""

    def label(x: Column) -> Column:
        text = F.concat_ws(
            "/",
            F.when(x["www"], F.lit("www 前缀")),
            F.when(x["rest"] != "", F.concat(F.lit("子域 "), x["rest"])),
            F.when(x["port"] != "", F.concat(F.lit("端口 "), x["port"].try_cast("int").cast("string"))),
            F.when(~x["path"].isin("", "/"), F.lit("带路径")),
        )
        return F.when(x["name"] == "", "").otherwise(F.when(text == "", "主站").otherwise(text))

    def without_www(x: Column) -> Column:
        www = (x["cut"] == "www") | x["cut"].startswith("www.")
        rest = F.when(www, F.substring(x["cut"], 5, 1 << 20)).otherwise(x["cut"])
        return _bound(F.struct(x["name"].alias("name"), www.alias("www"), rest.alias("rest"), port_text(url).alias("port"), path(url).alias("path")), label)

    def cut(x: Column) -> Column:
        below = (x["name"] != x["key"]) & F.endswith(x["name"], F.concat(F.lit("."), x["key"]))
        prefix = F.when(below, F.left(x["name"], F.length(x["name"]) - F.length(x["key"]) - 1)).otherwise("")
        return _bound(F.struct(x["name"].alias("name"), prefix.alias("cut")), without_www)

    return _bound(host(url), lambda name: _bound(F.struct(name.alias("name"), key_of_host(name).alias("key")), cut))


def url_features(url: Column) -> Column:
    """A struct of booleans by the names of ``FEATURE_WEIGHTS``; all null if unparseable."""
    return _bound(host(url), lambda name: _features(url, name))


def _features(url: Column, name: Column) -> Column:
    port = port_text(url)
    labels = F.split(name, r"\.")
    hyphens = F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit("")))
    there = {
        "punycode_host": name.contains("xn--"),
        "idn_non_ascii": name.rlike(r"[^\x00-\x7F]"),
        "suspicious_tld": F.element_at(labels, -1).isin(*SUSPICIOUS_TLDS),
        "subdomain_depth": F.size(labels) > 3,
        "hyphen_ratio": hyphens / F.length(name) > 0.3,
        "nonstd_port": (port != "") & ~port.isin("80", "443"),
        "ip_host": is_ip(name),
        "long_obfuscated_path": F.length(path(url)) > 120,
        "high_entropy_query": _part(url, 5).rlike(r"[0-9A-Za-z+/_-]{32,}"),
        "plain_http": F.lower(_part(url, 1)) == "http",
        "deceptive_prefix": F.exists(labels, lambda x: x.startswith("www-")),
    }
    return F.struct(*[F.when(name != "", c).alias(k) for k, c in there.items()])


def url_risk(features: Column) -> Column:
    """Weights of what holds, at most 1, in whole hundredths before the division."""
    total = None
    for k, w in FEATURE_WEIGHTS.items():
        part = F.when(features[k], round(w * 100)).otherwise(0)
        total = part if total is None else total + part
    return F.least(F.lit(100), total) / F.lit(100.0)


def normalised(raw: Column) -> Column:
    """A struct (url, reason) of one intake line: https:// is added, other schemes and bad hosts are rejected."""
    text = F.trim(raw)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    full = F.when(scheme == "", F.concat(F.lit("https://"), text)).otherwise(text)
    name = host(full)
    reason = F.when(text == "", "empty").when(~scheme.isin("", "http", "https"), "scheme").when((name == "") | name.rlike(r"\s"), "host")
    return F.struct(F.when(reason.isNull(), full).alias("url"), reason.alias("reason"))


def within_domains(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of ``domains`` or below one."""
    return F.coalesce(F.arrays_overlap(suffixes(name), F.array(*map(F.lit, domains))), F.lit(False))


def suffixes(name: Column) -> Column:
    """The host and all that follows each of its dots."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
