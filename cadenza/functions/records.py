"""Records from outside as Column expressions: links, JSON replies, notes, authors, categories and times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Site labels, categories of feedback, and limits of what is taken.
SITES = {"youtu.be": "youtube", "youtube.com": "youtube", "music.youtube.com": "youtube music", "m.youtube.com": "youtube", "soundcloud.com": "soundcloud", "on.soundcloud.com": "soundcloud", "m.soundcloud.com": "soundcloud", "bandcamp.com": "bandcamp", "vimeo.com": "vimeo", "mixcloud.com": "mixcloud"}
LINK_LENGTH, NOTE_LENGTH, AUTHOR_LENGTH = 2048, 400, 24
# End of fixed values.

#: IPv4 addresses that are no public host: private and shared networks, the machine itself, links, documentation, tests, multicast and what is reserved.
_PRIVATE = r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^22[4-9]\.|^2[3-5][0-9]\."
#: The same for IPv6: what is outside of 2000::/3, and in it protocol assignments, documentation and 6to4.
_PRIVATE_6 = r"^(?![23][0-9a-f]{3}:)|^2001:(?:0?[01]?[0-9a-f]{0,2})?:|^2001:0?db8:|^2002:|^3fff:0?[0-9a-f]{0,3}:"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port, brackets and a dot at its end; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(F.translate(host, "[]", ""), r"^\.+|\.+$", ""))


def link_problem(url: Column) -> Column:
    """Why a link is refused (empty, long, control, scheme, host, local), or null: only public http and https links are taken."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    scheme, host = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), host_of(raw)
    mapped = F.regexp_extract(host, r"^(?:0*:)*:?ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    address = F.when(mapped != "", mapped).otherwise(host)
    numbers = address.rlike(r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+))*$") & ~address.rlike(r"^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$")
    six = F.contains(address, F.lit(":"))
    local = host.isin("localhost", "localhost.localdomain", "ip6-localhost", "broadcasthost") | host.rlike(r"\.(?:local|internal|localhost)$") | F.when(six, ~address.rlike("^[0-9a-f:]+$") | address.rlike(_PRIVATE_6)).otherwise(~F.contains(address, F.lit(".")) | numbers | address.rlike(_PRIVATE))
    return F.when(raw == "", "empty").when(F.char_length(raw) > LINK_LENGTH, "long").when(raw.rlike(r"[\r\n\t\x00]"), "control").when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(local, "local")


def site(url: Column) -> Column:
    """A short label of where a link points."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    out = host
    for h, label in SITES.items():
        out = F.when(host == h, label).otherwise(out)
    return F.when(host == "", "link").otherwise(out)


def reply_object(text: Column) -> Column:
    """The JSON object in a reply: without fences, from the first { to the last }; null without one."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))


def score_100(text: Column) -> Column:
    """A score from 0 to 100 to one place: shares below 1 are scaled, what is no finite number is 0."""
    x = text.try_cast("double")
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when((x > 0) & (x < 1), x * 100).otherwise(x))), 1)


def tidy(text: Column, most: int = NOTE_LENGTH) -> Column:
    """Control characters are spaces, white space is single, and the length is limited."""
    return F.trim(F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), 1, most))


def author(text: Column, default: str = "listener") -> Column:
    own = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, AUTHOR_LENGTH)
    return F.when(own == "", default).otherwise(own)


def moment(t: Column, duration: Column | None = None) -> Column:
    """A finite time of 0 at least, the duration at most, to milliseconds; null otherwise."""
    t = t.try_cast("double")
    fit = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")) & (t >= 0)
    capped = t if duration is None else F.when(duration > 0, F.least(t, duration)).otherwise(t)
    return F.when(fit, F.bround(capped, 3))
