"""Rules over url, status, headers and timings, as SQL expressions that Catalyst runs and DuckDB understands.

Inputs: url, html, status, ms (response time), lcp, cls, inp, ttfb, fcp, the
path and query of the url, and headers through {header-name}. @match and
@count stand for the dialect's functions; @bytes for the length in bytes.
"""

from __future__ import annotations

import re

from pagelattice.plans.rules.registry import native

SPARK = {
    "match": "({0} rlike {1})",
    "count": "regexp_count({0}, {1})",
    "extract": "regexp_extract({0}, {1}, 1)",
    "bytes": "octet_length({0})",
    "header": "headers['{0}']",
    "int": "try_cast({0} as int)",
}
DUCKDB = {
    "match": "regexp_matches({0}, {1})",
    "count": "len(regexp_extract_all({0}, {1}))",
    "extract": "regexp_extract({0}, {1}, 1)",
    "bytes": "strlen({0})",
    "header": """json_extract_string(headers_json, '$."{0}"')""",
    "int": "try_cast({0} as int)",
}


def render(expression: str, dialect: dict[str, str]) -> str:
    """Fills @name(argument; argument) and {header} for a dialect."""
    out = re.sub(r"\{([a-z-]+)\}", lambda m: dialect["header"].format(m[1]), expression)
    while (at := out.find("@")) >= 0:
        name = re.match(r"\w+", out[at + 1 :])[0]
        open_ = at + 1 + len(name)
        depth, quoted, split, i = 0, False, None, open_
        while True:
            c = out[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == ";" and depth == 1:
                    split = i
                if not depth:
                    break
            i += 1
        first = out[open_ + 1 : split or i].strip()
        second = out[split + 1 : i].strip() if split else ""
        out = out[:at] + dialect[name].format(first, second) + out[i + 1 :]
    return _escape(out) if dialect is SPARK else out


def _escape(sql: str) -> str:
    """Spark reads backslashes in string literals, DuckDB does not."""
    return re.sub(r"'[^']*'", lambda m: m[0].replace("\\", "\\\\"), sql)


#: Derived inputs, in order.
PATH = r"coalesce(nullif(@extract(url; '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)'), ''), '/')"
QUERY = r"@extract(url; '^[^?#]*[?]([^#]*)')"


def case(*pairs: str, other: str = "P") -> str:
    return "case " + " ".join(f"when {c} then '{s}'" for s, c in (x.split(" ", 1) for x in pairs)) + f" else '{other}' end"


def _vital(rule_id: str, weight: int, column: str, good: float, poor: float) -> None:
    native(rule_id, weight, case(f"W {column} is null", f"P {column} < {good}", f"W {column} <= {poor}", other="F"))


_vital("cwv-lcp", 25, "lcp", 2500, 4000)
_vital("cwv-cls", 25, "cls", 0.1, 0.25)
_vital("cwv-inp", 20, "inp", 200, 500)
_vital("cwv-ttfb", 15, "ttfb", 800, 1800)
_vital("cwv-fcp", 15, "fcp", 1800, 3000)

# technical
native(
    "technical-url-structure",
    1,
    case(
        "F @match(path; '[_A-Z]')",
        r"W length(path) > 100 or length(url) > 2048 or @match(path; '--|[^a-zA-Z0-9/._~%-]|[.](php|asp|aspx|jsp|cgi)$')"
        " or (query <> '' and @count(query; '&') >= 3)",
    ),
)
native("technical-server-error", 10, case("F status >= 500"))
native("technical-4xx-non-404", 8, case("P status is null or status = 404 or status < 400 or status > 499", "F status in (401, 403)", "W status in (410, 429)", other="F"))
native("technical-timeout", 8, case("F ms > 10000", "W ms >= 3000"))
native(
    "technical-bad-content-type",
    8,
    case(
        "W {content-type} is null or {content-type} = ''",
        "P @match(lower({content-type}); '^ *(text/html|application/xhtml[+]xml) *(;|$)')",
        other="F",
    ),
)

# performance
native("perf-text-compression", 8, case("W {content-encoding} is null", "P @match(lower({content-encoding}); '(^|[, ])(gzip|br|deflate|zstd)([, ]|$)')", other="W"))
native("perf-brotli", 5, case("P @match(lower(coalesce({content-encoding}, '')); '(^|[, ])br([, ]|$)')", other="W"))
native(
    "perf-cache-policy",
    7,
    case(
        "P @match(lower(coalesce({cache-control}, '')); 'no-store|no-cache|max-age *= *[0-9]+')",
        "P {etag} is not null or {last-modified} is not null or {expires} is not null",
        other="W",
    ),
)
native("perf-response-time", 7, case("F ms > 1000", "W ms > 500"))
native("perf-http2", 5, case("P {alt-svc} is not null", other="W"))
native("perf-page-weight", 8, case("F @bytes(html) > 307200", "W @bytes(html) > 102400"))

# links
native("links-depth", 1, case("W @count(path; '[^/]+') > 3"))

# security
native("security-https", 10, case("P @match(lower(url); '^https:')", other="F"))
native(
    "security-hsts",
    6,
    case(
        "W @match(lower(url); '^http:')",
        "F not @match(lower(coalesce({strict-transport-security}, '')); 'max-age *= *[0-9]+')",
        "W @int(@extract(lower({strict-transport-security}); 'max-age *= *([0-9]+)')) < 31536000",
    ),
)
_CSP = "lower({content-security-policy})"
native(
    "security-csp",
    4,
    case(
        "W {content-security-policy} is null",
        "W not (" + " and ".join(f"@match({_CSP}; '{d}')" for d in ("default-src", "script-src", "style-src", "img-src", "frame-ancestors")) + ")",
    ),
)
native(
    "security-x-frame-options",
    5,
    case(
        "F {x-frame-options} is null and not @match(coalesce(lower({content-security-policy}), ''); 'frame-ancestors')",
        "P {x-frame-options} is null",
        "W @match(lower({x-frame-options}); '^ *allow-from')",
        "P @match(lower({x-frame-options}); '^ *(deny|sameorigin) *$')",
        other="F",
    ),
)
native("security-x-content-type-options", 4, case("P lower(coalesce({x-content-type-options}, '')) = 'nosniff'", other="F"))
native("security-permissions-policy", 2, case("P {permissions-policy} is not null", other="W"))
native(
    "security-ssl-expiry",
    8,
    case(
        "F not @match(lower(url); '^https:')",
        "W not @match(lower(coalesce({strict-transport-security}, '')); 'max-age *= *[0-9]+')",
        "W @int(@extract(lower({strict-transport-security}); 'max-age *= *([0-9]+)')) < 31536000",
    ),
)
native(
    "security-ssl-protocol",
    6,
    case(
        "F not @match(lower(url); '^https:') or {strict-transport-security} is null",
        "P @match(lower({strict-transport-security}); 'includesubdomains') and @match(lower({strict-transport-security}); 'preload')",
        other="W",
    ),
)

# content
native(
    "content-mime-type",
    5,
    case(
        "F not @match(lower(coalesce({content-type}, '')); 'text/html|application/xhtml')",
        "P @match(lower({content-type}); 'charset *= *\"?utf-?8')",
        other="W",
    ),
)

# url
native(
    "url-slug-keywords",
    15,
    case(
        r"F @match(url; '(?i)[.](php|asp|aspx|jsp|cgi)[?]') or @match(concat(path, case when query = '' then '' else '?' end, query); '(?i)^/?node/[0-9]+$|^/[?]p=[0-9]+$|^/?index[.](php|html?)([?]|$)')",
        "P path = '/'",
        r"F @match(path; '(?i)^/?[0-9]+/?$|^/?(p|post|page|article|product|item|id)[-_]?[0-9]+/?$|^/?untitled(-[0-9]+)?/?$|^/?new-page(-[0-9]+)?/?$|^/?copy(-of)?(-[0-9]+)?/?$')",
        r"W @match(path; '(?i)^/[0-9a-f]{16,}/?$')",
        r"P @match(path; '[a-zA-Z]{3,}')",
        other="W",
    ),
)
# Words that slugs can do without.
_STOP = (
    "a|an|the|about|above|after|at|before|below|between|by|for|from|in|into|of|on|to|under|with|without|and|but|or|nor|so|yet"
    "|i|me|my|you|your|he|she|it|its|we|our|they|their|this|that|these|those|which|who|whom|is|are|was|were|be|been|being"
    "|have|has|had|do|does|did|can|could|will|would|should|just|only|also|very|really|now|then|here|there|when|where|why|how"
    "|all|each|every|both|few|more|most|other|some|any|no|not"
)
native(
    "url-stop-words",
    10,
    case(
        "P @count(path; '[a-zA-Z0-9]+') = 0 or @match(lower(path); 'how-?to|what-?is')",
        rf"W @count(lower(path); '\b({_STOP})\b') > 0.4 * @count(path; '[a-zA-Z0-9]+')",
    ),
)
native("url-uppercase", 5, case("W @match(path; '[A-Z]')"))
native("url-underscores", 4, case("W @match(path; '_')"))
native("url-double-slash", 5, case("F @match(path; '//')"))
native("url-spaces", 6, case("F @match(concat(path, query); '%20| ')"))
native("url-non-ascii", 4, case(r"W @match(path; '[^\x20-\x7E]|%[89A-Fa-f][0-9A-Fa-f]')"))
native("url-length", 5, case("P length(url) <= 75", "W length(url) <= 200", other="F"))
native("url-parameters", 5, case("P query = ''", "P @count(query; '&') + 1 <= 2", "W @count(query; '&') + 1 <= 5", other="F"))
native(
    "url-session-ids",
    7,
    case(
        r"F @match(lower(concat(path, '?', query)); '[?&;](phpsessid|jsessionid|sid|sessionid|session_id|cfid|cftoken|zenid)=|[?&;]aspsessionid|/(phpsessid|jsessionid)[=/]|/sid[=/][0-9a-f]{16,}|/session/[0-9a-f-]{20,}')"
    ),
)
# Parameters that only track, and those of a site's own search.
_TRACK = (
    "utm_source|utm_medium|utm_campaign|utm_term|utm_content|utm_id|gclid|gclsrc|dclid|wbraid|gbraid|fbclid|fb_action_ids"
    "|fb_action_types|fb_source|msclkid|mc_cid|mc_eid|_hsenc|_hsmi|__hstc|__hsfp|ref|affiliate_id|zanpid|spm"
)
_SEARCH = "q|query|search|s|keyword|keywords|search_query|searchterm|search_term|terme|buscar|recherche|suche"
native("url-tracking-params", 5, case(rf"W @match(lower(query); '(^|&)({_TRACK})(=|&|$)')"))
native(
    "url-internal-search",
    4,
    case(
        rf"W @match(lower(query); '(^|&)({_SEARCH})(=|&|$)')",
        "W query <> '' and @match(lower(path); '/(search|results|search-results|site-search)/?$')",
    ),
)

# html, from the raw source
native("htmlval-missing-doctype", 15, case(r"P @match(html; '(?i)^\s*<!doctype\s')", other="F"))
native("htmlval-size-limit", 8, case("F @bytes(html) > 512000", "W @bytes(html) > 256000"))

# redirects
native("redirect-http-refresh", 10, case("F {refresh} is not null"))
native("redirect-type", 12, case("W status in (302, 303, 307)"))
