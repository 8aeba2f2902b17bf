"""Registered queries: operators over the driver's tables, with equivalent SQL where there is any."""
