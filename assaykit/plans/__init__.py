"""Plan building blocks: fused aggregates, distributed numbering, blocked windows."""
