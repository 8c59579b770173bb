"""Lazy plans: raw tables to marts, prices, risk, analytics and measures."""
