"""Column functions: everything here stays in JVM expressions unless its docstring says otherwise."""
