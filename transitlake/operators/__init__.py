"""Multi-step operators built from DataFrame primitives."""
