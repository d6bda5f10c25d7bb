"""DataFrame-to-DataFrame operators; none runs an action unless its docstring says so."""
