"""Operators for preparing training data. Each module is one operator; `catalog` registers their queries."""
