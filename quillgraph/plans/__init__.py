"""Control plane: rules as query plans, their compilation to joins, and exact analysis of small graphs on the driver."""
