"""Tables, resource bundles and value sets."""
