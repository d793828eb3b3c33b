"""Feature families and weights, told from the feature's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Family -> (order inside a line, weight).
FAMILIES = {"Shape": (0, 1.0), "Bucket": (1, 0.8), "KeyPres": (2, 0.5), "Canon": (3, 0.5), "Word": (4, 0.3), "Syslog": (5, 0.2)}


def family(feature: Column) -> Column:
    return (
        F.when(feature.startswith("k="), "KeyPres")
        .when(feature.startswith("canon="), "Canon")
        .when(feature.startswith("syslog_"), "Syslog")
        .when(feature.startswith("w="), "Word")
        .when(feature.contains("_net@"), "Bucket")
        .otherwise("Shape")
    )


def _by_family(fam: Column, at: int) -> Column:
    out = F.when(fam == "Shape", FAMILIES["Shape"][at])
    for name, values in list(FAMILIES.items())[1:]:
        out = out.when(fam == name, values[at])
    return out


def family_order(fam: Column) -> Column:
    return _by_family(fam, 0).cast("int")


def weight(feature: Column) -> Column:
    """Weight of a feature; exact identities (`SourceIp@..` and the like) weigh nothing."""
    identity = feature.rlike(r"^(SourceIp|DestIp|UserRaw|UserId|Domain|Host)@")
    return F.when(identity, 0.0).otherwise(_by_family(family(feature), 1))


def is_blob(feature: Column) -> Column:
    return feature.contains("<UUID>") | feature.contains("<HEX_") | feature.contains("<B64_")


def cap_class(feature: Column) -> Column:
    """Which per-window cap counts a feature: Word, Syslog, Shape or Other."""
    fam = family(feature)
    return F.when(fam.isin("Word", "Syslog", "Shape"), fam).otherwise("Other")


def drop_counter(feature: Column) -> Column:
    return F.when(feature.startswith("w="), "words").when(feature.startswith("shape="), "shapes").otherwise("features")
