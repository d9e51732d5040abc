from .plans.commands import main

main()
