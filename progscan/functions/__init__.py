"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from progscan.functions.binary import (  # noqa: F401
    le_hex,
    le_payload,
    swap_hex,
    read_unsigned,
)
from progscan.functions.codec import (  # noqa: F401
    cursor_encode,
    discriminator_hex,
    idl_hash_hex,
    lenient_unbase64,
    normalise_name,
    table_name,
)
