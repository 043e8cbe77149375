"""Column expressions."""

from txgraph.functions.hexval import (LONG_MAX, LONG_MIN, hex_quantity, hex_to_long,
                                      long_to_hex, strip_0x)
from txgraph.functions.scalars import first_of_first, pairs, ratio, square, xml_escape

__all__ = ["LONG_MAX", "LONG_MIN", "hex_quantity", "hex_to_long", "long_to_hex", "strip_0x",
           "first_of_first", "pairs", "ratio", "square", "xml_escape"]
