"""Upgrade-auction analytics on the PySpark DataFrame API."""
