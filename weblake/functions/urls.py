"""URL algebra as Column functions.

Written specification: a URL is trimmed, given a scheme if it has none, and cut by regular
expressions into scheme, authority, path, query and fragment. All functions take and return Columns
of built-in expressions; null or unusable input gives null.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblake.functions.columns import let

# Second-level public suffixes in common use, URL shorteners, parameter names of
# redirections and of tracking, language codes used as subdomains.
TWO_LEVEL_SUFFIXES = (
    "ac.uk co.uk gov.uk org.uk me.uk com.au net.au org.au gov.au co.nz co.jp ne.jp or.jp com.br gov.br "
    "com.cn com.tr com.mx com.ar co.in co.za co.kr com.sg com.hk com.tw gouv.fr asso.fr com.fr"
).split()
SHORTENERS = "bit.ly t.co goo.gl tinyurl.com ow.ly is.gd buff.ly dlvr.it ift.tt lnkd.in fb.me youtu.be wp.me j.mp trib.al amzn.to".split()
REDIRECT_KEYS = "url u redirect redirect_to redirect_uri target dest destination goto link to next".split()
TRACKING = r"^(?:utm_[^=]*|xtor|xtref|xts|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src|ref_url|feature|from|source|src|spm|wt_mc|cmpid|ncid|at_[^=]*|_ga)(?:=|$)"
LANGUAGES = "en fr de es it pt nl ru ar zh ja".split()

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
HOST_LABEL = r"[a-z0-9_](?:[a-z0-9_\-]*[a-z0-9_])?"
VALID = rf"^(?i)(?:https?://)?(?:[^/?#@\s]*@)?(?:{HOST_LABEL}\.)+[a-z][a-z0-9\-]*[a-z0-9](?::[0-9]+)?(?:[/?#]\S*)?$"


def or_null(c: Column) -> Column:
    return F.when(c != "", c)


@dataclass(frozen=True)
class SuffixRules:
    """Rules of public suffixes: plain ones, ``*.name`` (any one label before the name) and ``!name`` (no suffix, though a wildcard says so)."""

    plain: tuple[str, ...]
    wild: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()

    @classmethod
    def of(cls, lines: Iterable[str]) -> SuffixRules:
        """From a rule a line, as the public list has them: comments begin with ``//``, a rule ends at white space."""
        rules = sorted({line.split()[0].lower().lstrip(".") for line in lines if line.strip() and not line.strip().startswith("//")})
        pick = lambda mark: tuple(r[len(mark) :] for r in rules if r.startswith(mark))
        return cls(tuple(r for r in rules if r[0] not in "*!"), pick("*."), pick("!"))

    @property
    def top_level(self) -> list[str]:
        """Last labels of all rules."""
        return sorted({r.rsplit(".", 1)[-1] for r in (*self.plain, *self.wild)})


def is_url(c: Column, require_protocol: bool = False, allow_spaces_in_path: bool = False, tld_aware: bool = False, rules: SuffixRules | None = None) -> Column:
    """A web URL with a dotted host; IP hosts do not count; with ``tld_aware``, whose last label one of ``rules`` ends in."""
    if tld_aware:
        if rules is None:
            raise ValueError("tld_aware needs the rules of public suffixes")
        last = F.substring_index(get_hostname(c), ".", -1)
        return is_url(c, require_protocol, allow_spaces_in_path) & F.coalesce(last.isin(*rules.top_level), F.lit(False))
    pattern = VALID.replace("(?:https?://)?", "https?://") if require_protocol else VALID
    if allow_spaces_in_path:
        pattern = pattern.replace(r"(?:[/?#]\S*)?$", r"(?:[/?#].*)?$")
    return F.trim(c).rlike(pattern)


def ensure_protocol(c: Column, default: str = "https") -> Column:
    whole = lambda t: F.when(t.rlike(SCHEME), t).when(t.startswith("//"), F.concat(F.lit(f"{default}:"), t)).when(t != "", F.concat(F.lit(f"{default}://"), t))
    return let(F.trim(c), whole)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([^:/?#]+)://", 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^#]*#(.*)$", 1)


def get_hostname(c: Column) -> Column:
    """The full host, lowered, without user, port and trailing dot."""
    host = F.regexp_replace(F.regexp_replace(authority(ensure_protocol(c)), r"^.*@", ""), r"\.?(?::[0-9]*)?$", "")
    return F.nullif(F.lower(host), F.lit(""))


def _suffix_labels(host: Column, rules: SuffixRules | None = None) -> Column:
    """How many of a host's last labels are its public suffix: by the longest rule, one where none fits."""
    if rules is None:
        two = F.substring_index(host, ".", -2)
        return F.when(two.isin(*TWO_LEVEL_SUFFIXES), F.lit(2)).otherwise(F.lit(1))
    among = lambda name, names: name.isin(*names) if names else F.lit(False)

    def longest(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
        every = F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1)))
        found = F.filter(every, lambda n: among(last(n), rules.plain) | ((n > 1) & among(last(F.greatest(n - 1, F.lit(1))), rules.wild)))
        except_ = F.filter(every, lambda n: among(last(n), rules.exceptions))
        return F.coalesce(F.array_max(except_) - 1, F.array_max(found), F.lit(1))

    return let(F.split(host, r"\."), longest)


def _last_labels(host: Column, n: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def get_domain_name(c: Column, rules: SuffixRules | None = None) -> Column:
    """The registrable domain: one label more than the public suffix. Hosts of numbers or one label have none; nor, with ``rules``, have suffixes."""

    def named(host: Column) -> Column:
        n = _suffix_labels(host, rules)
        whole = host.contains(".") & ~host.rlike(r"^[0-9.]+$")
        return F.when(whole if rules is None else whole & (n < F.size(F.split(host, r"\."))), _last_labels(host, n + 1))

    return let(get_hostname(c), named)


def strip_subdomains(host: Column) -> Column:
    """Without leading labels that do not matter: www, www2 and so on, m, mobile."""
    return F.regexp_replace(host, r"^(?:(?:www[0-9]*|m|mobile)\.)+(?=[^.]+\.)", "")


def get_normalized_hostname(c: Column, infer: bool = False, normalize_amp: bool = False) -> Column:
    """The host without labels that do not matter: of the target that the URL carries, with ``infer``, and without ``amp.``, with ``normalize_amp``."""
    host = strip_subdomains(get_hostname(infer_redirection(ensure_protocol(c)) if infer else c))
    return F.regexp_replace(host, r"^amp\.(?=[^.]+\.)", "") if normalize_amp else host


def get_fingerprinted_hostname(c: Column, strip_suffix: bool = False, rules: SuffixRules | None = None) -> Column:
    """Without language subdomains either; may be no valid host."""
    host = F.regexp_replace(get_normalized_hostname(c), rf"^(?:{'|'.join(LANGUAGES)})\.(?=[^.]+\.)", "")
    if not strip_suffix:
        return host

    def without(h: Column) -> Column:
        labels = F.split(h, r"\.")
        return F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - F.when(h.contains("."), _suffix_labels(h, rules)).otherwise(0), F.lit(1))), ".")

    return let(host, without)


def solve_dots(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x))

    def solved(q: Column) -> Column:
        kept = F.array_join(F.aggregate(F.split(q, "/"), F.array().cast("array<string>"), step), "/")
        whole = F.concat(kept, F.when(q.rlike(r"/\.\.?$"), "/").otherwise(""))
        return F.when(q.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.regexp_replace(whole, "^(?=[^/])", "/")).otherwise(q)

    return let(p, solved)


def unquoted(c: Column) -> Column:
    """Percent-decoded, unless that would bring in characters that mean something in a URL."""
    decoded = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return let(c, lambda x: F.when(x.contains("%") & ~decoded(x).rlike(r"[%?#&=+/\s]"), decoded(x)).otherwise(x))


def _with(mark: str, c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise(""))


def _port(u: Column) -> Column:
    port = F.regexp_extract(authority(u), r":([0-9]+)$", 1)
    return F.when((port == "80") & (scheme(u) == "http") | (port == "443") & (scheme(u) == "https"), "").otherwise(_with(":", port))


def _user(u: Column) -> Column:
    return F.regexp_extract(authority(u), r"^(.*@)", 1)


def canonicalize_url(c: Column, quoted: bool = False, strip_fragment: bool = False) -> Column:
    """Clean but equivalent: lowered scheme and host, no default port, no dot segments, no empty path."""

    def canonical(u: Column) -> Column:
        p = solve_dots(path(u))
        if not quoted:
            p = F.array_join(F.transform(F.split(p, "/"), unquoted), "/")
        out = F.concat(scheme(u), F.lit("://"), _user(u), get_hostname(u), _port(u), F.regexp_replace(p, "^/$", ""), _with("?", query(u)))
        return out if strip_fragment else F.concat(out, _with("#", fragment(u)))

    return let(ensure_protocol(c), canonical)


def infer_redirection(c: Column, recursive: bool = True) -> Column:
    """The target that a query parameter of a known name carries, else the URL itself.

    ``q`` is such a name on the redirection pages of search and video sites. Recursive: until nothing
    changes; each target's own ``http`` stands in the text around it, which bounds the rounds.
    """
    keys = "|".join(REDIRECT_KEYS)
    carrier = rf"(?i)(?:[?&](?:{keys})|(?:youtube|google)\.[a-z.]+/(?:redirect|url)\?(?:[^#&]*&)*q)=(https?(?:://|%3A%2F%2F)[^&#]*)"

    def once(c: Column) -> Column:
        held = lambda u: F.regexp_extract(u, carrier, 1)
        return let(c, lambda u: let(held(u), lambda h: F.when(h != "", F.coalesce(F.try_url_decode(h), h)).otherwise(u)))

    if not recursive:
        return once(c)
    return let(c, lambda u: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split(u, "(?i)http")) - 1)), u, lambda acc, _: once(acc)))


def kept_query(q: Column, sort: bool = True) -> Column:
    """Query items that do not track, sorted."""
    items = F.filter(F.split(q, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    return F.array_join(F.array_sort(items) if sort else items, "&")


def normalize_url(
    c: Column,
    infer: bool = True,
    fix_common_mistakes: bool = True,
    normalize_amp: bool = True,
    quoted: bool = False,
    sort_query: bool = True,
    strip_authentication: bool = True,
    strip_fragment: bool | str = "except-routing",
    strip_index: bool = True,
    strip_irrelevant_subdomains: bool = True,
    strip_protocol: bool = True,
    strip_trailing_slash: bool = True,
    platform_aware: bool = False,
) -> Column:
    """What identifies the resource: see the toggles. A fragment is kept as routing if it has a slash.

    platform_aware: an address of a platform that names a video, post, user and so on counts as the one
    that ``platform_url`` makes of its ids.
    """
    u = ensure_protocol(c)
    if fix_common_mistakes:
        u = F.regexp_replace(F.regexp_replace(u, "&amp;", "&"), r"^(https?)://(?:https?:?//)+", "$1://")
    if infer:
        u = infer_redirection(u)
    if platform_aware:
        u = let(u, lambda x: F.coalesce(platform_url(x), x))

    def normalized(u: Column) -> Column:
        host = strip_subdomains(get_hostname(u)) if strip_irrelevant_subdomains else get_hostname(u)
        p = solve_dots(path(u))
        if not quoted:
            p = F.array_join(F.transform(F.split(p, "/"), unquoted), "/")
        if normalize_amp:
            host = F.regexp_replace(host, r"^amp\.(?=[^.]+\.)", "")
            p = F.regexp_replace(p, r"(?:/amp/?|\.amp)$", "")
        if strip_index:
            p = F.regexp_replace(p, r"/(?i:index|default|home)\.(?i:html?|php|aspx?|jsp)$", "/")
        if strip_trailing_slash:
            p = F.regexp_replace(p, "/+$", "")
        frag = fragment(u)
        if strip_fragment == "except-routing":
            frag = let(frag, lambda x: F.when(x.contains("/"), x).otherwise(""))
        head = F.lit("") if strip_protocol else F.concat(scheme(u), F.lit("://"))
        user = F.lit("") if strip_authentication else _user(u)
        out = F.concat(head, user, host, _port(u), p, _with("?", kept_query(query(u), sort_query)))
        return out if strip_fragment is True else F.concat(out, _with("#", frag))

    return let(u, normalized)


def fingerprint_url(c: Column, strip_suffix: bool = False, platform_aware: bool = False) -> Column:
    """A key for aggregation: the normalized URL, lowered, with its fingerprinted host."""
    rest = F.regexp_replace(normalize_url(c, platform_aware=platform_aware), r"^[^/?#]*", "")
    target = infer_redirection(ensure_protocol(c))
    if platform_aware:
        target = let(target, lambda x: F.coalesce(platform_url(x), x))
    return F.lower(F.concat(get_fingerprinted_hostname(target, strip_suffix), rest))


def is_shortened_url(c: Column) -> Column:
    return get_normalized_hostname(c).isin(*SHORTENERS)


def should_resolve(c: Column) -> Column:
    return is_shortened_url(c) | get_normalized_hostname(c).isin("doi.org", "dx.doi.org", "hdl.handle.net")


def is_typo_url(c: Column) -> Column:
    """A word with a full stop before a short ending, as inclusive writing has it: no scheme, no path."""
    return F.trim(c).rlike(r"(?i)^[a-zéèê]+(?:eur|teur|if|al|nt|é)?\.(?:e|se|es|ses|ne|nes|ve|ves|le|rice|trice)s?$")


def is_homepage(c: Column) -> Column:
    return path(ensure_protocol(c)).rlike(r"^/?$|^/(?i:index|default|home)\.(?i:html?|php|aspx?|jsp)$") & (query(ensure_protocol(c)) == "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(path(ensure_protocol(c)), r"\.([a-zA-Z0-9]+)$", 1))


def could_be_html(c: Column) -> Column:
    """No extension, or one of pages and scripts."""
    return extension(c).rlike(r"^(?:|x?html?|php[0-9]?|aspx?|jsp|cgi|shtml|cfm|do|fr|com|net|org)$|^[0-9]+$")


def could_be_rss(c: Column) -> Column:
    return extension(c).isin("rss", "xml", "atom", "rdf") | path(ensure_protocol(c)).rlike(r"(?i)(?:^|/)(?:feeds?|rss|atom)(?:/|$)")


def should_follow_href(c: Column) -> Column:
    t = F.trim(c)
    return (t != "") & ~t.rlike(r"(?i)^(?:javascript|mailto|tel|data|sms|about|blob):|^#")


def url_join(base: Column, ref: Column) -> Column:
    """Reference resolution: absolute, //host, /path, ?query, #fragment or relative."""

    def joined(r: Column, b: Column) -> Column:
        root = F.regexp_extract(b, r"^([^:/?#]+://[^/?#]*)", 1)
        folder = F.regexp_replace(F.regexp_replace(path(b), "[^/]*$", ""), "^$", "/")
        rel_path, tail = F.regexp_extract(r, r"^([^?#]*)", 1), F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
        return (
            F.when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), r)
            .when(r.startswith("//"), F.concat(F.regexp_extract(b, "^([^:/?#]+:)", 1), r))
            .when(r == "", F.regexp_replace(b, "#.*$", ""))
            .when(r.startswith("?"), F.concat(root, path(b), r))
            .when(r.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), r))
            .otherwise(F.concat(root, solve_dots(F.concat(F.when(r.startswith("/"), "").otherwise(folder), rel_path)), tail))
        )

    return let(F.trim(base), lambda b: let(F.trim(ref), lambda r: joined(r, b)))


def lru(c: Column, with_scheme: bool = True, strip_fragment: bool = False, suffix_aware: bool = False) -> Column:
    """Ordered stems of a URL: scheme, host labels from the top level down, port, path parts, query, fragment."""

    def host_stems(host: Column) -> Column:
        labels = F.split(host, r"\.")
        if not suffix_aware:
            return F.reverse(labels)
        n = _suffix_labels(host)
        return F.concat(F.array(_last_labels(host, n)), F.reverse(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - n, F.lit(0)))))

    def stems(u: Column) -> Column:
        one = lambda kind, x: F.array(F.nullif(F.concat(F.lit(f"{kind}:"), x), F.lit(f"{kind}:")))
        tagged = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind}:"), x))
        head = [one("s", scheme(u))] if with_scheme else []
        end = [] if strip_fragment else [one("f", fragment(u))]
        parts = F.filter(F.split(path(u), "/"), lambda x: x != "")
        port = F.regexp_extract(authority(u), r":([0-9]+)$", 1)
        return F.array_compact(F.concat(*head, tagged("h", let(get_hostname(u), host_stems)), one("t", port), tagged("p", parts), one("q", query(u)), *end))

    return let(c, stems)


def normalized_lru(c: Column) -> Column:
    """Stems of the normalized URL, without scheme: the key of the URL-prefix join."""
    return lru(F.concat(F.lit("http://"), normalize_url(c)), with_scheme=False)


def _cases(*pairs: tuple[Column, Column]) -> Column:
    first, rest = pairs[0], pairs[1:]
    return reduce(lambda acc, p: acc.when(*p), rest, F.when(*first))


def _group(u: Column, pattern: str, n: int = 1) -> Column:
    return or_null(F.regexp_extract(u, pattern, n))


def parse_facebook_url(c: Column) -> Column:
    """struct(type, id, full_id, handle, url); null unless the URL is of that site and known shape."""

    def parsed(u: Column) -> Column:
        on = get_hostname(u).rlike(r"(?:^|\.)(?:facebook\.com|fb\.com|fb\.watch)$")
        p = path(u)
        group = _group(p, r"^/groups/([^/]+)")
        post = F.coalesce(_group(p, r"^/[^/]+/posts/([0-9]+)/?$"), _group(p, r"^/groups/[^/]+/(?:posts|permalink)/([0-9]+)"), _group(u, r"[?&]story_fbid=([0-9]+)"))
        photo = F.coalesce(_group(p, r"^/[^/]+/photos/(?:[^/]+/)?([0-9]+)"), _group(u, r"/photo(?:\.php)?/?\?(?:[^#]*&)?fbid=([0-9]+)"))
        video = F.coalesce(_group(p, r"/videos/(?:[^/]+/)?([0-9]+)"), _group(u, r"/watch/?\?(?:[^#]*&)?v=([0-9]+)"))
        user = F.coalesce(_group(u, r"/profile\.php\?(?:[^#]*&)?id=([0-9]+)"), _group(p, r"^/people/[^/]+/([0-9]+)"))
        owner = F.coalesce(_group(u, r"[?&]id=([0-9]+)"), _group(p, r"^/([0-9]+)/(?:posts|photos|videos)/"), F.when(group.rlike("^[0-9]+$"), group))
        handle = F.when(~p.rlike(r"^/(?:groups|watch|people|photo|profile\.php|permalink\.php|story\.php|pages|events|hashtag)(?:[/.?]|$)"), _group(p, r"^/([A-Za-z0-9.\-]+)(?:/|$)"))
        handle = F.when(~handle.rlike("^[0-9]+$"), handle)
        kind = _cases((video.isNotNull(), F.lit("video")), (photo.isNotNull(), F.lit("photo")), (post.isNotNull(), F.lit("post")), (group.isNotNull(), F.lit("group")), (user.isNotNull(), F.lit("user")), (handle.isNotNull(), F.lit("handle")))
        id_ = _cases((kind == "video", video), (kind == "photo", photo), (kind == "post", post), (kind == "group", F.when(group.rlike("^[0-9]+$"), group)), (kind == "user", user))
        full = F.when((kind == "post") & owner.isNotNull(), F.concat_ws("_", owner, post))
        clean = F.concat(F.lit("https://www.facebook.com"), F.regexp_replace(p, "/+$", ""))
        return F.when(on & kind.isNotNull(), F.struct(kind.alias("type"), id_.alias("id"), full.alias("full_id"), handle.alias("handle"), clean.alias("url")))

    return let(ensure_protocol(c), parsed)


def parse_youtube_url(c: Column) -> Column:
    """struct(type, id, name, normalized_url)."""

    def parsed(u: Column) -> Column:
        return let(get_normalized_hostname(u), lambda host: let(path(u), lambda p: found(u, host, p)))

    def found(u: Column, host: Column, p: Column) -> Column:
        video_id = r"([A-Za-z0-9_\-]{11})"
        video = F.coalesce(F.when(host == "youtu.be", _group(p, f"^/{video_id}")), F.when(p.rlike("^/watch"), _group(u, f"[?&]v={video_id}")), _group(p, f"^/(?:embed|v|vi|e|live)/{video_id}"))
        short, channel = _group(p, f"^/shorts/{video_id}"), _group(p, r"^/channel/([A-Za-z0-9_\-]+)")
        name = F.coalesce(_group(p, r"^/user/([^/]+)"), _group(p, r"^/c/([^/]+)"), _group(p, r"^/@([^/]+)"))
        return let(short, lambda s: let(video, lambda v: let(channel, lambda c: let(name, lambda n: named(host, p, s, v, c, n)))))

    def named(host: Column, p: Column, short: Column, video: Column, channel: Column, name: Column) -> Column:
        on = host.rlike(r"^(?:[a-z]+\.)?youtube(?:-nocookie)?\.com$|^youtu\.be$")
        kind = _cases((short.isNotNull(), F.lit("short")), (video.isNotNull(), F.lit("video")), (channel.isNotNull(), F.lit("channel")), (p.startswith("/user/") & name.isNotNull(), F.lit("user")), (name.isNotNull(), F.lit("channel")))
        id_ = F.coalesce(short, video, channel)
        base = F.lit("https://www.youtube.com")
        clean = _cases((kind == "short", F.concat(base, F.lit("/shorts/"), short)), (kind == "video", F.concat(base, F.lit("/watch?v="), video)), (channel.isNotNull(), F.concat(base, F.lit("/channel/"), channel)), (kind == "user", F.concat(base, F.lit("/user/"), name)), (name.isNotNull(), F.concat(base, F.lit("/c/"), name)))
        return F.when(on & kind.isNotNull(), F.struct(kind.alias("type"), id_.alias("id"), F.when(id_.isNull(), name).alias("name"), clean.alias("normalized_url")))

    return let(ensure_protocol(c), parsed)


def parse_twitter_url(c: Column) -> Column:
    """struct(type, screen_name, tweet_id)."""

    def parsed(u: Column) -> Column:
        p = path(u)
        on = get_normalized_hostname(u).isin("twitter.com", "x.com")
        tweet = _group(p, r"^/[^/]+/status(?:es)?/([0-9]+)")
        name = F.lower(_group(p, r"^/@?([A-Za-z0-9_]{1,15})(?:/|$)"))
        name = F.when(~name.isin("i", "home", "search", "hashtag", "explore", "settings", "intent", "share", "login"), name)
        kind = F.when(tweet.isNotNull(), "tweet").when(name.isNotNull(), "user")
        return F.when(on & kind.isNotNull(), F.struct(kind.alias("type"), name.alias("screen_name"), tweet.alias("tweet_id")))

    return let(ensure_protocol(c), parsed)


def platform_url(c: Column) -> Column:
    """The one address of what a platform's URL names, made of its ids; null for other URLs and platform pages without any.

    Videos of a site are one whether watched, embedded or short; posts go by owner and number however
    they are linked; screen names, which the platforms do not tell apart by case, are lowered.
    """
    site = F.lit("https://www.facebook.com/")

    def facebook(f: Column) -> Column:
        group = or_null(F.regexp_extract(f["url"], r"/groups/([^/?#]+)", 1))
        owner = F.coalesce(F.when(f["full_id"].isNotNull(), F.substring_index(f["full_id"], "_", 1)), F.lower(f["handle"]))
        post = F.when(group.isNotNull(), F.concat(site, F.lit("groups/"), group, F.lit("/posts/"), f["id"])).when(owner.isNotNull(), F.concat(site, owner, F.lit("/posts/"), f["id"]))
        return _cases(
            (f["type"] == "video", F.concat(site, F.lit("watch?v="), f["id"])), (f["type"] == "photo", F.concat(site, F.lit("photo?fbid="), f["id"])), (f["type"] == "post", post),
            (f["type"] == "group", F.concat(site, F.lit("groups/"), group)), (f["type"] == "user", F.concat(site, F.lit("profile.php?id="), f["id"])), (f["type"] == "handle", F.concat(site, F.lower(f["handle"]))),
        )

    def youtube(y: Column) -> Column:
        return F.when(y["type"].isin("video", "short"), F.concat(F.lit("https://www.youtube.com/watch?v="), y["id"])).otherwise(y["normalized_url"])

    def twitter(t: Column) -> Column:
        user = F.concat(F.lit("https://twitter.com/"), F.lower(t["screen_name"]))
        return F.when(t["tweet_id"].isNotNull(), F.concat(user, F.lit("/status/"), t["tweet_id"])).otherwise(user)

    return let(c, lambda u: F.coalesce(let(parse_facebook_url(u), facebook), let(parse_youtube_url(u), youtube), let(parse_twitter_url(u), twitter)))


def parse_bluesky_post_url(c: Column) -> Column:
    """struct(actor, rkey): the second and fourth part of the path."""
    parts = F.split(path(ensure_protocol(c)), "/")
    return F.when((get_hostname(c) == "bsky.app") & (F.get(parts, 1) == "profile") & (F.get(parts, 3) == "post"), F.struct(F.get(parts, 2).alias("actor"), F.get(parts, 4).alias("rkey")))


def format_at_uri(did: Column, rkey: Column) -> Column:
    return F.concat(F.lit("at://"), did, F.lit("/app.bsky.feed.post/"), rkey)


def telegram_public_url(c: Column, desc: bool = True) -> Column:
    """The public listing of a channel, by its name or the URL of it or of a message; groups have none."""
    t = F.trim(c)
    name = F.coalesce(_group(t, r"^@?([A-Za-z][A-Za-z0-9_]{3,})$"), F.when(get_hostname(t).isin("t.me", "telegram.me"), _group(path(ensure_protocol(t)), r"^/(?:s/)?([A-Za-z][A-Za-z0-9_]{3,})(?:/|$)")))
    return F.when(~name.isin("joinchat", "addstickers"), F.concat(F.lit("https://t.me/s/"), name, F.lit("" if desc else "/1")))


def apply_template(template: str, value: Column, **fields: Column) -> Column:
    """``{value}`` and ``{field}`` (or ``{field:a:b}`` for the characters a up to b) filled in; nothing is evaluated."""
    import re

    known = {"value": value, **fields}
    out = []
    for literal, name, start, end in re.findall(r"([^{}]+)|\{(\w+)(?::(\d*):(\d*))?\}", template):
        if literal:
            out.append(F.lit(literal))
            continue
        if name not in known:
            raise ValueError(f"unknown field in template: {name}")
        c = known[name].cast("string")
        if start or end:
            a = int(start or 0)
            c = F.substring(c, a + 1, int(end) - a if end else 1 << 30)
        out.append(F.coalesce(c, F.lit("")))
    return F.concat(*out)


def url_report(df, column: str, strip_suffix: bool = False, **options):
    """All columns of ``df`` and the URL report; rows of invalid URLs have nulls in it."""
    c = F.trim(F.col(column))
    found = {
        "canonicalized_url": canonicalize_url(c, quoted=options.get("quoted", False)),
        "normalized_url": normalize_url(c, **options),
        "fingerprinted_url": fingerprint_url(c, strip_suffix),
        "inferred_redirection": infer_redirection(c),
        "domain_name": get_domain_name(c),
        "hostname": get_hostname(c),
        "normalized_hostname": get_normalized_hostname(c),
        "fingerprinted_hostname": get_fingerprinted_hostname(c, strip_suffix),
        "probably_shortened": is_shortened_url(c),
        "probably_typo": is_typo_url(c),
        "probably_homepage": is_homepage(c),
        "should_resolve": should_resolve(c),
        "could_be_html": could_be_html(c),
        "could_be_rss": could_be_rss(c),
    }
    valid = is_url(c)
    return df.select("*", *(F.when(valid, v).alias(k) for k, v in found.items()))


def platform_report(df, column: str, platform: str):
    """All columns of ``df`` and what the URL says on that platform, nulls where it says nothing."""
    c = F.trim(F.col(column))
    parsed, names = {
        "facebook": (parse_facebook_url(c), ("type", "id", "full_id", "handle", "url")),
        "youtube": (parse_youtube_url(c), ("type", "id", "name", "normalized_url")),
        "twitter": (parse_twitter_url(c), ("type", "screen_name", "tweet_id")),
    }[platform]
    return df.select("*", parsed.alias("found")).select(*df.columns, *(F.col(f"found.{n}").alias(f"{platform}_{n}") for n in names))
