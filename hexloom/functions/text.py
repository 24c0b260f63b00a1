"""Text normalisers for the point inventories, as SQL expression text."""

from __future__ import annotations

from hexloom.sources.fixed_values import MISSING_GENUS


def _clean(name: str) -> str:
    return f"lower(trim({name}))"


def normalize_genus(genus: str, species: str, missing: tuple[str, ...] = ("", MISSING_GENUS)) -> str:
    """Lower-case genus; one of the ``missing`` words falls back to the first word of the species, if any.

    The words are a parameter, since inventories differ in what they write for an unknown genus.
    """
    absent = ", ".join(f"'{word}'" for word in missing)
    first = f"nullif(split_part({_clean(species)}, ' ', 1), '')"
    return f"if(coalesce({_clean(genus)}, '') IN ({absent}), {first}, {_clean(genus)})"


def normalize_species(species: str) -> str:
    """Lower-case species up to the quoted cultivar; '' when absent."""
    return f"coalesce(rtrim(split_part({_clean(species)}, '\\'', 1)), '')"


def surrogate_key(source: str, identifier: str) -> str:
    """Stable md5 key of a source and its own identifier; NULL when either is NULL."""
    return f"md5({source} || '_' || {identifier})"


def label_codes(code: str, labels: dict[str, str], default: str = "Unknown") -> str:
    """Code to label; codes outside the table get ``default``."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in labels.items())
    return f"coalesce(try_element_at(map({pairs}), {code}), '{default}')"
