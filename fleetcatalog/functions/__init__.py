from .paths import known_method, pair_request, path_prefix, tuple_request, typed_path, typed_request
from .text import (
    artifact_name,
    compat_version,
    config_present,
    env_name,
    flag_args,
    is_pair,
    list_text,
    major_minor_tag,
    name_hex,
    name_or_path,
    package_name,
    pair_key,
    pair_value,
    version_rank,
)
from .units import binary_bytes, decimal_bytes, round_up_kib, whole_seconds
from .uris import uri_port

__all__ = [
    "artifact_name",
    "binary_bytes",
    "compat_version",
    "config_present",
    "decimal_bytes",
    "env_name",
    "flag_args",
    "is_pair",
    "known_method",
    "list_text",
    "major_minor_tag",
    "name_hex",
    "name_or_path",
    "package_name",
    "pair_key",
    "pair_request",
    "pair_value",
    "path_prefix",
    "round_up_kib",
    "tuple_request",
    "typed_path",
    "typed_request",
    "uri_port",
    "version_rank",
    "whole_seconds",
]
