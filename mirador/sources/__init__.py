"""Tables, formats and connectors."""
