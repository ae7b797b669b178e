"""TLS fingerprint and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.fixed_values import (
    SUSPICIOUS_TLDS,
    TLS_VERSION_SCORES,
    UNKNOWN_TLS_VERSION,
    WEAK_CIPHERS,
)

# Fixed value: a dotted-quad host name.
_OCTET = r"\+?0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _hash_of(parts: list[Column]) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    joined = [texts[0]]
    for t in texts[1:]:
        joined += [F.lit(","), t]
    return F.md5(F.concat(*joined))


def ja3_hash(
    version: Column, ciphers: Column, extensions: Column, curves: Column, point_formats: Column
) -> Column:
    """Client fingerprint: md5 of five comma-joined hello fields, missing ones left empty."""
    return _hash_of([version, ciphers, extensions, curves, point_formats])


def ja3s_hash(version: Column, cipher: Column, extensions: Column) -> Column:
    """Server fingerprint: md5 of three comma-joined hello fields."""
    return _hash_of([version, cipher, extensions])


def metadata_fingerprint(version: Column, cipher: Column, server_name: Column) -> Column:
    """Stand-in fingerprint from negotiated metadata; NULL when neither version nor cipher is known."""
    unknown = F.lit("unknown")
    return F.when(
        version.isNotNull() | cipher.isNotNull(),
        _hash_of([F.coalesce(c, unknown) for c in (version, cipher, server_name)]),
    )


def version_score(version: Column) -> Column:
    """Weakness of a TLS version; NULL stays NULL."""
    score = None
    for name, value in TLS_VERSION_SCORES.items():
        score = F.when(version == name, value) if score is None else score.when(version == name, value)
    return score.when(version.isNotNull(), UNKNOWN_TLS_VERSION)


def weak_cipher(cipher: Column) -> Column:
    """The first listed weak algorithm inside the suite name, or NULL."""
    upper = F.upper(cipher)
    found = None
    for weak in WEAK_CIPHERS:
        hit = upper.contains(weak.upper())
        found = F.when(hit, weak) if found is None else found.when(hit, weak)
    return found


def shannon_entropy(text: Column) -> Column:
    """Bits per character of the lower-cased text. Occurrences are counted by taking a character out
    of the text, which is one native string operation per distinct character."""

    def of_lower(lower: Column) -> Column:
        n = F.length(lower)

        def minus_p_log_p(c: Column) -> Column:
            p = (n - F.length(F.replace(lower, c, F.lit("")))) / n
            return -p * F.log2(p)

        distinct = F.array_distinct(F.filter(F.split(lower, ""), lambda c: c != ""))
        return F.aggregate(F.transform(distinct, minus_p_log_p), F.lit(0.0), lambda acc, t: acc + t)

    # bound through a one-element array, so that the text is lower-cased once and not per character
    return F.transform(F.array(F.lower(text)), of_lower)[0]


def label_entropy(name: Column) -> Column:
    """Entropy of a first label of more than 20 characters; NULL for shorter ones, which are not judged."""
    first = F.substring_index(name, ".", 1)
    return F.when(F.length(first) > 20, shannon_entropy(first))


def server_name_risk(name: Column, entropy: Column | None = None) -> Column:
    """Highest of the host-name findings; 0 for an unremarkable name, NULL for none. ``entropy``: the
    ``label_entropy``, when it has been computed into a column."""
    labels = F.size(F.split(name, r"\."))
    suspicious = F.lit(False)
    for tld in SUSPICIOUS_TLDS:
        suspicious = suspicious | name.endswith(tld)
    random_label = (label_entropy(name) if entropy is None else entropy) > 3.5
    return F.when(
        name.isNotNull(),
        F.greatest(
            F.when(name.rlike(IPV4_PATTERN), 0.3).otherwise(0.0),
            F.when(F.length(name) > 50, 0.35).otherwise(0.0),
            F.when(random_label, 0.4).otherwise(0.0),
            F.when(labels > 5, 0.25).otherwise(0.0),
            F.when(suspicious, 0.2).otherwise(0.0),
        ),
    )
