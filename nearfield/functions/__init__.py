"""Column functions: vector arithmetic, hashes, decoding and formatting."""

from nearfield.functions.decode import decode_f32, decode_vector, encode_f32, json_bigint, json_vector, json_vector_strict, url_param
from nearfield.functions.hashing import fnv1a64, fnv1a64_long, fnv1a64_string, unsigned_text, vnode_key
from nearfield.functions.vectors import cosine_distance, dim_ok, dot, l2, l2_sq, norm, normalize, preview, register

__all__ = [
    "cosine_distance", "decode_f32", "decode_vector", "dim_ok", "dot", "encode_f32", "fnv1a64", "fnv1a64_long", "fnv1a64_string", "json_bigint", "json_vector",
    "json_vector_strict", "l2", "l2_sq", "norm", "normalize", "preview", "register", "unsigned_text", "url_param", "vnode_key",
]
