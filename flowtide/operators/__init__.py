"""DataFrame-to-DataFrame operators. Nothing here runs an action unless its docstring says so."""
