"""Scalar column functions (built-in Spark expressions only)."""

from tillroll.functions.keys import hex_tail_to_long, order_instance, l3_l4_key
from tillroll.functions.numeric import round_half_even, clamp_at_zero
from tillroll.functions import calendar

__all__ = ["hex_tail_to_long", "order_instance", "l3_l4_key",
           "round_half_even", "clamp_at_zero", "calendar"]
