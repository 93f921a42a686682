"""Driver-table bindings, registered queries and end-to-end flows."""
