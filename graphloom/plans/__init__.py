"""Pass runner, tool surface and the catalogue of registered queries."""
