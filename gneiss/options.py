"""Switches of a profile, with their limits."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ProfileOptions:
    fetch_size: int = 10_000
    query_timeout_seconds: int = 0
    enum_print_threshold: int = 20
    low_cardinality_tracking_limit: int = 100
    top_value_limit: int = 20
    pattern_limit: int = 128
    min_hash_bins: int = 32
    clob_preview_chars: int = 0
    trim_strings: bool = True
    distinct_enabled: bool = True
    value_frequency_enabled: bool = True
    range_enabled: bool = True
    length_enabled: bool = True
    pattern_profile_enabled: bool = False
    string_shape_enabled: bool = False
    case_variant_tracking_enabled: bool = False
    relationship_fingerprint_enabled: bool = False
    semantic_null_tokens: tuple[str, ...] | None = ("NULL", "N/A", "NA")

    def __post_init__(self):
        for name in ("fetch_size", "enum_print_threshold", "low_cardinality_tracking_limit", "top_value_limit", "pattern_limit", "min_hash_bins"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("query_timeout_seconds", "clob_preview_chars"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.low_cardinality_tracking_limit < self.enum_print_threshold:
            raise ValueError("low_cardinality_tracking_limit must be at least enum_print_threshold")
        if self.value_frequency_enabled and not self.distinct_enabled:
            raise ValueError("value_frequency_enabled needs distinct_enabled")
        if self.relationship_fingerprint_enabled and not self.distinct_enabled:
            raise ValueError("relationship_fingerprint_enabled needs distinct_enabled")
        tokens = {t.strip().upper() for t in self.semantic_null_tokens or () if t is not None}
        object.__setattr__(self, "semantic_null_tokens", tuple(sorted(tokens)))

    def everything(self) -> ProfileOptions:
        """With all the optional metrics on."""
        return replace(self, pattern_profile_enabled=True, string_shape_enabled=True, case_variant_tracking_enabled=True, relationship_fingerprint_enabled=True)

    def snapshot(self) -> dict:
        """What a manifest records."""
        left_out = {"query_timeout_seconds", "pattern_limit", "min_hash_bins", "semantic_null_tokens"}
        return {camel(k): v for k, v in self.__dict__.items() if k not in left_out}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)
