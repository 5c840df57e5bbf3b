"""The alias dictionary of label fields."""

from __future__ import annotations

import re

#: Fields in order, each with its aliases in order. The order decides between aliases of one length.
FIELD_ALIASES: dict[str, list[str]] = {
    "BUYER": ["BUYER", "BUYER NAME", "CUSTOMER", "CUSTOMER NAME"],
    "BUYER CODE": ["BUYER CODE", "BUYERCODE", "BUYER ID", "CUSTOMER CODE", "CUSTOMER ID"],
    "VENDOR": ["VENDOR", "SUPPLIER", "VENDOR NAME", "SUPPLIER NAME"],
    "PO NO": ["PO NO", "PO NUMBER", "P.O. NO", "P.O NO", "P.O. NUMBER", "PONO", "PURCHASE ORDER", "PURCHASE ORDER NO", "PURCHASE ORDER NUMBER"],
    "STYLE NO": ["STYLE NO", "STYLE NUMBER", "STYLE", "STYLE CODE", "STY NO", "STY NUMBER"],
    "DESCRIPTION": ["DESCRIPTION", "DESC", "ITEM DESCRIPTION", "PRODUCT DESCRIPTION"],
    "COLOR": ["COLOR", "COLOUR", "COLOR NAME", "COLOUR NAME"],
    "SIZE": ["SIZE", "SIZE NAME", "SIZE CODE"],
    "QTY": ["QTY", "QUANTITY", "PCS", "PIECES", "QTY/PCS", "QTY PCS", "TOTAL PCS"],
    "TOTAL QTY": ["TOTAL QTY", "TOTAL QUANTITY", "TOTAL PCS", "TOTAL PIECES"],
    "G.W.": ["G.W.", "G.W", "GW", "GROSS WEIGHT", "GROSS WT"],
    "N.W.": ["N.W.", "N.W", "NW", "NET WEIGHT", "NET WT"],
    "MEASUREMENT": ["MEASUREMENT", "MEASUREMENTS", "MEASURE", "DIMENSION", "DIMENSIONS"],
    "VOLUME": ["VOLUME", "CBM", "CUBIC METER", "CUBIC METRE"],
    "CARTON NO": ["CARTON NO", "CARTON NUMBER", "CARTON", "CTN NO", "CTN NUMBER", "CARTON #"],
    "COUNTRY OF ORIGIN": ["COUNTRY OF ORIGIN", "ORIGIN", "MADE IN", "COUNTRY"],
    "DESTINATION": ["DESTINATION", "DEST", "FINAL DESTINATION"],
    "PORT OF LOADING": ["PORT OF LOADING", "LOADING PORT", "POL"],
    "PORT OF DISCHARGE": ["PORT OF DISCHARGE", "DISCHARGE PORT", "POD"],
    "SHIPMENT MODE": ["SHIPMENT MODE", "MODE OF SHIPMENT", "MODE", "SHIP MODE"],
    "ETD": ["ETD", "ESTIMATED TIME OF DEPARTURE", "EST. TIME OF DEPARTURE"],
    "ETA": ["ETA", "ESTIMATED TIME OF ARRIVAL", "EST. TIME OF ARRIVAL"],
}
FIELDS = list(FIELD_ALIASES)


def _label(value: str) -> str:
    value = re.sub(r"[.:;]+$", "", value.upper().strip().replace("_", " ").replace("|", " "))
    return re.sub(r"\s+", " ", re.sub("-+", " ", value)).strip()


def labels_of(field: str) -> list[str]:
    """The field's name and aliases as labels, without repeats, longest first."""
    return sorted(dict.fromkeys(map(_label, [field, *FIELD_ALIASES[field]])), key=len, reverse=True)


def own_aliases(field: str) -> list[str]:
    """Like labels_of, but of the aliases alone."""
    return sorted(map(_label, FIELD_ALIASES[field]), key=len, reverse=True)


def owners() -> dict[str, str]:
    """Each label's field: the first in order that has it. Longest labels first."""
    pairs = [(a, f) for f in FIELDS for a in labels_of(f)]
    out: dict[str, str] = {}
    for a, f in sorted(pairs, key=lambda p: -len(p[0])):
        out.setdefault(a, f)
    return out


_SPECIAL = r"([.#/\\+*?()\[\]{}|^$-])"


def alternation(labels) -> str:
    """A pattern of the labels, longest first, that Java and RE2 read alike."""
    return "|".join(re.sub(_SPECIAL, r"\\\1", a) for a in labels)


def prefix_tree(labels) -> str:
    """A pattern that finds what alternation finds, the longest label first, and tells by each character which labels remain."""
    after: dict[str, list[str]] = {}
    for a in labels:
        if a:
            after.setdefault(a[0], []).append(a[1:])
    each = "|".join(re.sub(_SPECIAL, r"\\\1", c) + prefix_tree(rest) for c, rest in after.items())
    if "" in labels:
        return f"(?:{each})?" if each else ""
    return f"(?:{each})" if len(after) > 1 else each
