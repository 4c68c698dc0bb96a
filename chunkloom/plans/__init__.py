"""End-to-end plans: decode, encode, analyse; and the registered queries."""
